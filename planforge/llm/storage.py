"""Intermediate tables in the folder that the driver and all executors share, and keys of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000  # long texts: smaller batches than Spark's own


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster sets it, else the context's checkpoint folder.

    A temporary folder only where one machine runs everything (a local master).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/planforge-checkpoints"
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: the lineage ends there.

    The files have the result's real size, so a later join broadcasts the table
    only if that size is under ``spark.sql.autoBroadcastJoinThreshold``.  The
    table is deleted when the driver ends, or before by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/planforge/{what}-{uuid.uuid4().hex}"
    if int(spark.conf.get(BATCH)) not in range(1, ROWS + 1):
        spark.conf.set(BATCH, str(ROWS))  # once for the session
    df.write.parquet(path)
    place, system = _path(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing will read again."""
    for df in tables:
        place, system = _path(df.sparkSession, df.written_to)
        system.delete(place, True)


def row_key(*columns: Column) -> Column:
    """128 bits that tell rows apart by these columns; a null counts as a value of its own."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(*(F.xxhash64(F.lit(seed), *marked).alias(name) for seed, name in ((1, "k1"), (2, "k2"))))
