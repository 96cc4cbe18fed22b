"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

BITS = 6  # cells per dimension: 2**BITS
SHARDS = 8
WHOLE_GROUP = 200  # a group of equal texts stays together if it is under 1/WHOLE_GROUP of a shard


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with integer coordinates below 2**bits.

    Coordinates are taken bit by bit from the top: at each level the current
    orientation (a reflection and an exchange of axes) turns the coordinate
    bits into the Gray-coded octant, whose rank is the next digit.
    """
    x = [np.array(c, dtype=np.int64) for c in cells]
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the reflections and exchanges of each level below
        mask = level - 1
        x[0] = np.where(x[0] & level, x[0] ^ mask, x[0])
        for i in range(1, n):
            high = (x[i] & level) != 0
            swap = (x[0] ^ x[i]) & mask
            x[0], x[i] = np.where(high, x[0] ^ mask, x[0] ^ swap), np.where(high, x[i], x[i] ^ swap)
        level >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where(x[n - 1] & level, flip ^ (level - 1), flip)
        level >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def _cell(column: Column) -> Column:
    """Categories keep their cell whatever else the table holds; null has its own value."""
    return F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))), F.lit(1 << BITS))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition and sums the sizes before each."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        s = batch.column(batch.schema.get_field_index("size")).to_numpy()
        upto = size + np.cumsum(s)
        n = len(s)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(rows + np.arange(n)), pa.array(upto - s)], names=[*batch.schema.names, "part", "row", "before"])
        rows, size = rows + n, int(upto[-1]) if n else size


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Places every document in one of ``shards`` shards of near equal bytes.

    Size: UTF-8 bytes of the text plus 1 (null: 1).  Language, source and the
    logarithm of the size are quantised to 64 cells each; documents are ordered
    by the Hilbert index of their cells, and runs of the order are cut at equal
    sums of sizes, so a shard covers few cells.  Equal texts form a group that
    takes the cells of its first document; a group is placed whole if it is
    under 1/200 of a shard, and document by document otherwise.

    The order comes from a range partitioning whose keys end with the id, so
    that neither a full cell nor a large group fills one task; row numbers and
    sums are carried over by one small row per partition.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard`` (and
    ``row_col`` if given): one row per input row; law is ``bytes``,
    ``grown_shard`` null.  Null ids come first among equals; null texts are
    groups of their own; identical rows get different slots.  An empty table
    gives no rows.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    own = F.xxhash64(F.lit("null text"), F.col(id_col))
    level = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(size.cast("double")) * 2)).cast("long")
    slim = docs.select(
        F.col(id_col).alias("id"), *([F.col(row_col).alias("unique")] if row_col else []), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.when(text.isNull(), own).otherwise(F.xxhash64(text)).alias("g1"), F.when(text.isNull(), own).otherwise(F.hash(text, F.octet_length(text)).cast("long")).alias("g2"),
        _cell(F.col(lang_col)).alias("lang"), _cell(F.col(source_col)).alias("source"), level.alias("level"),
    )
    slim = materialize(slim, "shard-sizes")
    groups = slim.groupBy("g1", "g2").agg(F.min(F.struct("id", "lang", "source", "level")).alias("m"), F.sum("size").alias("g_bytes"))
    groups = groups.select("g1", "g2", "g_bytes", F.pandas_udf(_curve, "long")(F.col("m.lang"), F.col("m.source"), F.col("m.level")).alias("curve"))
    groups = materialize(groups, "shard-groups")
    placed = slim.drop("lang", "source", "level").join(groups, ["g1", "g2"])
    order = ["curve", "g1", "g2", "id", "size", *(["unique"] if row_col else [])]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"{n} {t}" for n, t in placed.dtypes)
    placed = materialize(placed.mapInArrow(_offsets, types + ", part long, row long, before long"), "shard-order")
    sums = sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect())
    starts, rows, total = [], 0, 0
    for part, n, bytes_ in sums:  # one row per partition of the order
        starts.append((part, rows, total))
        rows, total = rows + n, total + bytes_
    # by Arrow: a list would be read by Python workers of its own kind, beside those of mapInArrow on each executor
    names = ("part", "rows_before", "bytes_before")
    table = docs.sparkSession.createDataFrame(pa.table({n: pa.array(np.array([s[i] for s in starts], np.int64)) for i, n in enumerate(names)}))
    placed = placed.join(F.broadcast(table), "part").withColumn("at", F.col("row") + F.col("rows_before")).withColumn("from", F.col("before") + F.col("bytes_before"))
    whole = F.col("g_bytes") * (shards * WHOLE_GROUP) < max(total, 1)
    edges = materialize(placed.where(whole).groupBy("g1", "g2").agg(F.min("from").alias("g_from")), "shard-edges")
    placed = placed.join(edges, ["g1", "g2"], "left")
    middle = F.when(F.col("g_from").isNull(), F.col("from") + F.col("size") / 2).otherwise(F.col("g_from") + F.col("g_bytes") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int"))
    placed = materialize(placed.select("id", *(["unique"] if row_col else []), "size", "crc", "shard", "at"), "shard-places")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}
    slot = F.col("at")
    for shard, start in first.items():
        slot = F.when(F.col("shard") == shard, F.col("at") - start).otherwise(slot)
    out = placed.select(F.col("id").alias(id_col), *([F.col("unique").alias(row_col)] if row_col else []), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return out


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, id_col: str = "doc_id", **columns: str) -> None:
    """Writes ``docs`` to ``path/shard=k``, each shard's rows in slot order within its files."""
    kept = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "shard-input")
    places = shard_documents(kept, shards=shards, id_col=id_col, row_col="_row", **columns).select("_row", "shard", "slot")
    kept.join(places, "_row").drop("_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
