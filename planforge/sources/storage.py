"""Intermediate and persisted tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


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


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back, which ends its lineage.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/planforge/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, through the file system that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, through the file system that Spark would use for the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_or_build(spark: SparkSession, path: str, load: Callable[[str], T], build: Callable[[], T], store: Callable[[T, str], None]) -> T:
    """Loads what is stored at ``path``; otherwise builds it, stores it there and returns it."""
    if exists(spark, path):
        return load(path)
    made = build()
    store(made, path)
    return made


def join_path(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *(str(PurePosixPath(p)) for p in parts)])
