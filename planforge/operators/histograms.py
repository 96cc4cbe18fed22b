"""Equi-depth histogram hierarchies over a filter column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import column_distribution
from .ordered import ordered_scan


def equi_depth_split(df: DataFrame, column: str) -> DataFrame:
    """First value whose cumulative count exceeds half of all rows; null counts as smallest."""
    total = df.count()
    scan = ordered_scan(column_distribution(df, column), [F.asc_nulls_first(column)], sums={"cum": "n"})
    return scan.where(F.col("cum") > total // 2).agg(F.min(column).alias("cutoff"))


def bucket_edges(df: DataFrame, column: str, depth: int) -> list[list]:
    """Inner upper edges of each level's buckets: level k cuts the column into up to 2**k.

    All levels come from one scan of the distinct values: a bucket's edge is
    the first value whose cumulative count reaches its share of the rows.  Only
    the edges reach the driver.
    """
    total = df.count()
    if not total:
        return [[] for _ in range(depth)]
    cells = 1 << (depth - 1)
    scan = ordered_scan(column_distribution(df, column), [F.asc_nulls_first(column)], sums={"cum": "n"})
    cell = F.least(F.lit(cells - 1), F.floor((F.col("cum") - 1) * cells / F.lit(total)))
    top = {r.cell: r.edge for r in scan.groupBy(cell.cast("int").alias("cell")).agg(F.max(column).alias("edge")).collect()}
    out = []
    for level in range(depth):
        step = cells >> level
        edges: list = []
        for upto in range(step, cells, step):
            seen = [top[c] for c in range(upto) if c in top and top[c] is not None]
            if seen and (not edges or seen[-1] != edges[-1]):
                edges.append(seen[-1])
        out.append(edges)
    return out


def bucket_of(column: str, edges: list) -> Column:
    """Number of the bucket that holds the value; null is in the first."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(F.col(column).isNull() | (F.col(column) <= F.lit(edges[i])), i).otherwise(out)
    return out.cast("int")


def level_degrees(df: DataFrame, bucket: Column, join_column: str) -> DataFrame:
    """(bucket, join value, deg) of one level: one aggregation for all its buckets."""
    kept = df.where(F.col(join_column).isNotNull()).withColumn("bucket", bucket)
    return kept.groupBy("bucket", join_column).agg(F.count(F.lit(1)).alias("deg"))


def range_lookup(buckets: DataFrame, lo, hi) -> DataFrame:
    """Deepest level with a bucket that encloses [lo, hi]; ``buckets``: (lvl, lo, hi)."""
    return buckets.where((F.col("lo") <= lo) & (F.col("hi") >= hi)).agg(F.max("lvl").alias("lvl"))
