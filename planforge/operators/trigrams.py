"""Trigram frequencies of text columns and degrees conditioned on trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.functions.scalars import trigrams

from .ordered import ordered_scan


def exploded(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep.., gram): one row per trigram occurrence."""
    return df.select(*keep, F.explode(trigrams(text)).alias("gram"))


def trigram_counts(df: DataFrame, text: str) -> DataFrame:
    return exploded(df, text).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def trigram_rank(df: DataFrame, text: str) -> DataFrame:
    """(gram, n, rnk): dense rank by frequency; the distinct frequencies are numbered and joined on."""
    counts = trigram_counts(df, text)
    ranks = ordered_scan(counts.select("n").distinct(), [F.desc("n")], number="rnk")
    return counts.join(ranks, "n").select("gram", "n", F.col("rnk").cast("long").alias("rnk"))


def _ranked_degrees(df: DataFrame, text: str, join_column: str) -> DataFrame:
    """Occurrences by (gram, join value), aggregated before the ranks are joined on."""
    degrees = exploded(df.where(F.col(join_column).isNotNull()), text, join_column).groupBy("gram", join_column).agg(F.count(F.lit(1)).alias("deg"))
    return degrees.join(trigram_rank(df, text).select("gram", "rnk"), "gram")


def frequent_trigram_degrees(df: DataFrame, text: str, join_column: str, k: int) -> DataFrame:
    return _ranked_degrees(df, text, join_column).where(F.col("rnk") <= k).select("gram", join_column, "deg")


def rare_trigram_degrees(df: DataFrame, text: str, join_column: str, k: int) -> DataFrame:
    rare = _ranked_degrees(df, text, join_column).where(F.col("rnk") > k)
    return rare.groupBy(join_column).agg(F.sum("deg").alias("deg"))


def pattern_parts(pattern: str) -> list[str]:
    """Literal parts of a LIKE pattern; both wildcards separate."""
    return [p for p in pattern.replace("_", "%").split("%") if p]


def pattern_trigrams(pattern: str) -> list[str]:
    return [p[i : i + 3] for p in pattern_parts(pattern) for i in range(len(p) - 2)]
