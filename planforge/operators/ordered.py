"""Row numbers and running sums over a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planforge.sources.storage import materialize


def ordered_scan(df: DataFrame, order: list[Column], *, number: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``number`` (from 1) and running sums (inclusive) in ``order``, which must be total.

    Rows are range-partitioned and written; each partition numbers its own, and
    one small row per partition carries the counts and sums of those before.
    """
    sums = sums or {}
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = sorted(parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values()))).collect())
    rows, carried = [], [0] * (1 + len(sums))
    for part, *own in totals:
        rows.append((part, *carried))
        carried = [a + (b or 0) for a, b in zip(carried, own, strict=True)]
    kinds = ["long", *(dict(df.agg(F.sum(c).alias("x")).dtypes)["x"] for c in sums.values())]
    names = [f"_c{i}" for i in range(len(carried))]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    w = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(offsets), "_part")  # one row per partition
    if number:
        out = out.withColumn(number, F.row_number().over(w) + F.col("_c0"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, (name, column) in enumerate(sums.items()):
        out = out.withColumn(name, F.sum(column).over(running) + F.col(f"_c{i + 1}"))
    return out.drop("_part", *names)
