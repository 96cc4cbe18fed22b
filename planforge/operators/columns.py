"""Column statistics: the relational building blocks of every estimator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_values(df: DataFrame, column: str, *, drop_null: bool = False) -> DataFrame:
    out = df.select(column)
    return out.where(F.col(column).isNotNull()) if drop_null else out


def filter_card(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate).agg(F.count(F.lit(1)).alias("card"))


def like_card(df: DataFrame, column: str, pattern: str, *, negated: bool = False, ignore_case: bool = False) -> DataFrame:
    hit = F.col(column).ilike(pattern) if ignore_case else F.col(column).like(pattern)
    return filter_card(df, ~hit if negated else hit)


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def table_cardinality(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n) of each table; each count is read from file footers where the source allows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def column_count(df: DataFrame, column: str) -> DataFrame:
    """Non-null count per value: the null group counts 0."""
    return df.groupBy(column).agg(F.count(column).alias("n"))


def column_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mcv(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most common values; ties by value, null first."""
    return column_distribution(df, column).orderBy(F.desc("n"), F.asc_nulls_first(column)).limit(k)


def max_freq(df: DataFrame, column: str) -> DataFrame:
    """Frequency of the most common value that can join (null never does)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n").alias("mf"))


def uniform_freq(df: DataFrame, column: str) -> DataFrame:
    """Frequency if all values were equally common; 1 without values."""
    return df.agg(F.coalesce(F.expr(f"count(1) div nullif(count(distinct {column}), 0)"), F.lit(1)).alias("f"))


def top_product(tables: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """Product of the ``k`` largest table sizes: a ceiling for any cardinality."""
    top = table_cardinality(tables).orderBy(F.desc("n"), "tbl").limit(k)
    return top.agg(F.expr("aggregate(collect_list(cast(n as double)), cast(1 as double), (a, x) -> a * x)").alias("p"))


def frequency(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, freq): rows that share the key's value.

    The counts are aggregated first and joined, so a frequent value is not
    gathered in one window partition.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    return df.select(key, column).join(counts.withColumnRenamed(column, "_v"), F.col(column).eqNullSafe(F.col("_v"))).select(key, "freq")
