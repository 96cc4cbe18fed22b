"""Degree sequences in run-length form.

A degree sequence lists a column's value frequencies in descending order.  A
table of N rows has at most sqrt(2 N) different frequencies, so the runs
(degree, how many values have it) are small however many values there are;
ranks, cumulative degrees and join bounds come from the runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16


def degrees(df: DataFrame, column: str, *, where: Column | str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., column, deg): rows per join value; null never joins and has no degree."""
    kept = df.where(F.col(column).isNotNull())
    kept = kept if where is None else kept.where(where)
    return kept.groupBy(*by, column).agg(F.count(F.lit(1)).alias("deg"))


def runs(degree_table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., deg, m, before, mass): m values have degree deg, after ``before`` values with ``mass`` rows in all."""
    h = degree_table.groupBy(*by, "deg").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*by).orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return h.withColumns({"before": F.coalesce(F.sum("m").over(w), zero), "mass": F.coalesce(F.sum(F.col("m") * F.col("deg")).over(w), zero)})


def expand(run_table: DataFrame) -> DataFrame:
    """Runs with one row per rank: adds ``rnk`` from 1.  Long runs are unrolled block by block."""
    blocks = run_table.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {BLOCK}"))))
    last = F.least(F.col("m"), (F.col("_b") + 1) * BLOCK)
    return blocks.withColumn("_i", F.explode(F.sequence(F.col("_b") * BLOCK + 1, last))).withColumn("rnk", F.col("before") + F.col("_i")).drop("_b", "_i")


def degree_sequence(df: DataFrame, column: str) -> DataFrame:
    return expand(runs(degrees(df, column))).select("rnk", "deg")


def cumulative_degree(df: DataFrame, column: str) -> DataFrame:
    out = expand(runs(degrees(df, column)))
    return out.select("rnk", "deg", (F.col("mass") + (F.col("rnk") - F.col("before")) * F.col("deg")).alias("cum"))


def degree_summary(df: DataFrame, column: str) -> DataFrame:
    return degrees(df, column).agg(F.max("deg").alias("max_deg"), F.min("deg").alias("min_deg"), F.count(F.lit(1)).alias("n_distinct"), F.sum("deg").alias("card"))


def join_bound(left: DataFrame, right: DataFrame) -> DataFrame:
    """Largest size of the equi-join of two degree tables: the dot product by rank.

    The runs of both sides are laid over each other at the union of their ends,
    so no rank is unrolled.
    """
    a, b = runs(left), runs(right)
    ends = a.select((F.col("before") + F.col("m")).alias("end"), F.col("deg").alias("da"), F.lit(None).cast("long").alias("db"))
    ends = ends.unionByName(b.select((F.col("before") + F.col("m")).alias("end"), F.lit(None).cast("long").alias("da"), F.col("deg").alias("db")))
    ends = ends.groupBy("end").agg(F.max("da").alias("da"), F.max("db").alias("db"))
    ahead = Window.orderBy("end").rowsBetween(0, Window.unboundedFollowing)
    pieces = ends.select("end", F.lag("end", 1, 0).over(Window.orderBy("end")).alias("start"), F.first("da", ignorenulls=True).over(ahead).alias("da"), F.first("db", ignorenulls=True).over(ahead).alias("db"))
    return pieces.agg(F.coalesce(F.sum((F.col("end") - F.col("start")) * F.col("da") * F.col("db")), F.lit(0)).cast("long").alias("bound"))


def selfjoin_size(df: DataFrame, column: str) -> DataFrame:
    return degrees(df, column).agg(F.coalesce(F.sum(F.col("deg") * F.col("deg")), F.lit(0)).cast("long").alias("bound"))


def non_mcv_degrees(df: DataFrame, column: str, filter_column: str, k: int) -> DataFrame:
    """Degrees of the rows whose filter value is not among the ``k`` most common."""
    top = df.groupBy(filter_column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(filter_column)).limit(k).select(F.col(filter_column).alias("_v"))
    return degrees(df.join(top, F.col(filter_column).eqNullSafe(F.col("_v")), "left_anti"), column)


def compress_runs(deg: np.ndarray, m: np.ndarray, accuracy: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments (slope, width) whose cumulative function dominates that of the sequence.

    Values are taken in descending order of degree d.  A value joins the open
    segment of slope s at the price s*d - d*d in join size and width d/s; the
    price of a segment stays under ``accuracy`` times the self-join size, else
    the value opens a segment of its own.  Equal degrees are taken together.
    """
    limit = accuracy * float((m * deg.astype(float) ** 2).sum())
    slopes: list[float] = []
    widths: list[float] = []
    price = 0.0
    for d, n in zip(deg.astype(float), m.astype(int), strict=True):
        if slopes:
            step = slopes[-1] * d - d * d
            fits = n if step <= 0 and price < limit else 0 if step <= 0 else max(0, int(np.ceil((limit - price) / step)) - 1)
            fits = min(n, fits)
            price += fits * step
            widths[-1] += fits * d / slopes[-1]
            n -= fits
        if n:
            slopes.append(d)
            widths.append(float(n))
            price = 0.0
    return np.array(slopes), np.array(widths)


def valid_compress(degree_table: DataFrame, accuracy: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., seg, slope, width) per group; a group's runs are at most sqrt(2 N) rows."""
    table = runs(degree_table, by).select(*by, "deg", "m")
    kinds = dict(table.dtypes)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("deg", ascending=False)
        slope, width = compress_runs(pdf["deg"].to_numpy(), pdf["m"].to_numpy(), accuracy)
        return pd.DataFrame({**dict(zip(by, key, strict=True)), "seg": np.arange(len(slope)), "slope": slope, "width": width})

    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in by), "seg long", "slope double", "width double"])
    return table.groupBy(*by).applyInPandas(fold, ddl)
