"""Collecting executions as a stream, retraining when enough new ones have come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "query string, plan string, cardinality long, runtime_ms double, ts timestamp"


def sample_stream(spark: SparkSession, path: str, *, schema: str = SAMPLES, files_per_trigger: int = 1000) -> DataFrame:
    """Samples from a folder to which executions append Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def runtime_windows(samples: DataFrame, *, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(window, n, runtime_ms, slowest_ms) of the stream; rows later than ``lateness`` are dropped by the watermark."""
    timed = samples.withWatermark("ts", lateness)
    g = timed.groupBy(F.window("ts", window))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("runtime_ms").alias("runtime_ms"), F.max("runtime_ms").alias("slowest_ms"))


class ExperienceSink:
    """A ``foreachBatch`` function: appends each batch to a table and calls ``train`` every ``every`` new rows.

    Batches are written to folders named by their number, so a batch that is
    replayed after a failure replaces itself.  ``train`` gets the last
    ``window`` rows by time.
    """

    def __init__(self, path: str, train: Callable[[DataFrame], None], *, every: int = 100, window: int = 2000) -> None:
        self.path, self.train, self.every, self.window = path, train, every, window
        self.fresh, self.counted = 0, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        target = f"{self.path}/batch={number}"
        batch.where("cardinality > 0").write.mode("overwrite").parquet(target)
        if number > self.counted:
            self.counted = number
            self.fresh += batch.sparkSession.read.parquet(target).count()
        if self.fresh >= self.every:
            rows = batch.sparkSession.read.parquet(self.path)
            self.train(rows.orderBy(F.desc("ts"), "query").limit(self.window))
            self.fresh = 0


def collect_experience(samples: DataFrame, sink: ExperienceSink, checkpoint: str, *, once: bool = True):
    """Starts the stream; with ``once`` it handles what is there and ends."""
    writer = samples.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
