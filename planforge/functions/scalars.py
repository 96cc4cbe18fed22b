"""Encodings and label transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planforge.operators.ordered import ordered_scan


def _extent(df: DataFrame, value: Column) -> DataFrame:
    """``df`` with the value, its least and its greatest: one aggregate row joined to all."""
    v = df.withColumn("_v", value)
    return v.join(F.broadcast(v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))))  # one row


def minmax_encode(df: DataFrame, key: str, column: str, digits: int = 6) -> DataFrame:
    """(x - min) / (max - min); 0 if there is only one value."""
    e = _extent(df.select(key, column), F.col(column).cast("double"))
    return e.select(key, F.round(F.coalesce((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.when(F.col("_v").isNotNull(), 0.0)), digits).alias("enc"))


def offset_encode(df: DataFrame, key: str, value: Column, offset: float, digits: int = 4) -> DataFrame:
    """(x + offset - min) / (max - min + offset): never 0, so that 0 can mean absent."""
    e = _extent(df, value.cast("double"))
    return e.select(key, F.round((F.col("_v") + offset - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + offset), digits).alias("enc"))


def epoch(column: str) -> Column:
    return F.unix_timestamp(F.col(column).cast("timestamp"))


def ordinal_encode(df: DataFrame, key: str, column: str, digits: int = 6) -> DataFrame:
    """Distinct values below x over distinct values; ranks are given to distinct values and joined."""
    values = df.select(F.col(column).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    ranks = ordered_scan(values, [F.asc("_v")], number="_i")
    n = ranks.agg(F.max("_i").alias("_n"))
    share = ranks.join(F.broadcast(n)).select("_v", ((F.col("_i") - 1) / F.col("_n").cast("double")).alias("_r"))  # one row
    return df.select(key, column).join(share, F.col(column) == F.col("_v"), "left").select(key, F.round("_r", digits).alias("enc"))


def label_encode(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Values numbered by ascending count (then value), normalised with offset 1."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ordered_scan(counts, [F.asc("_n"), F.asc(column)], number="_i")
    top = numbered.agg(F.max("_i").alias("_m"))
    return numbered.join(F.broadcast(top)).select(column, F.round(F.col("_i") / F.col("_m").cast("double"), digits).alias("enc"))  # one row


def hash_encode(column: str, digits: int = 4) -> Column:
    """First 8 bytes of the MD5, little-endian, over 2**64."""
    h = F.md5(F.col(column).cast("binary"))
    number = sum((F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double") * F.lit(float(256**i)) for i in reversed(range(7))), F.conv(F.substring(h, 15, 2), 16, 10).cast("double") * F.lit(float(256**7)))
    return F.round((number + 1) / F.lit(float(2**64) + 1), digits)


def wildcard_encode(df: DataFrame, column: str, pattern: str, digits: int = 4) -> DataFrame:
    hits = F.sum(F.when(F.col(column).like(pattern), 1).otherwise(0))
    return df.agg(F.round((F.coalesce(hits, F.lit(0)) + 0.001) / (F.count(F.lit(1)) + 0.001), digits).alias("enc"))


def log_normalize(value: Column, top: float, digits: int = 6) -> Column:
    return F.round(F.least(F.greatest(F.log1p(value) / F.log1p(F.lit(top)), F.lit(0.0)), F.lit(1.0)), digits)


def log_denormalize(value: Column, top: float) -> Column:
    """Inverse of log_normalize inside its range."""
    return F.expm1(value * F.log1p(F.lit(top)))


def qerror(estimate: Column, truth: Column) -> Column:
    """Factor between estimate and truth, both at least 1."""
    e, t = F.greatest(estimate, F.lit(1.0)), F.greatest(truth, F.lit(1.0))
    return F.greatest(e / t, t / e)


def one_hot(column: str, value: str) -> Column:
    return (F.col(column) == value).cast("int")


def trigrams(column: str) -> Column:
    """Array of the 3-character substrings; empty for shorter strings and null."""
    s = F.col(column)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, grams).otherwise(F.array().cast("array<string>"))


def bit(mask: Column, position: Column) -> Column:
    return F.call_function("getbit", mask, position.cast("int")).cast("int")


def success_ratio(better: Column, used: Column, smoothing: float = 1.0) -> Column:
    """Laplace-smoothed share of the uses that were better."""
    return (better + smoothing) / (used + 2 * smoothing)
