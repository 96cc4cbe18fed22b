"""Fuzzy line deduplication: MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .banding import BUCKET_ROWS, PACKED_DDL, band_hashes, band_members, linked_classes, pack_bands, prefilter
from .minhash import distinct, document_key
from .repeats import plan_bytes
from .storage import materialize

SHINGLE = 10  # characters
ROWS, BANDS = 3, 16  # a pair at similarity 0.8 shares no band with probability 1e-5
BLOCK = 1024  # lines that a task compares with each other
MINIMA = ROWS * BANDS
PERCENT = 80
EMPTY = np.uint32(0xFFFFFFFF)
CHUNK = 1 << 17  # bytes whose code points and hashes stay in a core's cache


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without separators at their ends; one of separators alone is empty."""
    for _ in range(4):  # few lines have more
        loose = np.flatnonzero(starts < ends)
        first, last = K.SEPARATOR[data[starts[loose]]], K.SEPARATOR[data[ends[loose] - 1]]
        if not (first.any() or last.any()):
            return starts, ends
        starts[loose] += first
        ends[loose] -= last & ~(first & (ends[loose] - starts[loose] < 1))
    solid = np.flatnonzero(~K.SEPARATOR[data])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    keep = np.flatnonzero(j > i)
    ends[:] = starts
    starts[keep], ends[keep] = solid[i[keep]], solid[j[keep] - 1] + 1
    return starts, ends


class Lines:
    """The trimmed, lower-cased (A-Z) lines with a word of a chunk, as ranges of bytes, each named by a digest."""

    def __init__(self, c: K.Chunk) -> None:
        data = K.LOWER[c.data]
        newline = np.flatnonzero(data == 10)
        at, to = np.sort(np.concatenate([c.starts, newline + 1]), kind="stable"), np.sort(np.concatenate([newline, c.ends]), kind="stable")
        own = np.sort(np.concatenate([c.starts * 2 + 1, (newline + 1) * 2]), kind="stable") & 1  # a document's own first line comes after the last line of the one before
        doc = np.cumsum(own) - 1
        number = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(c)))[doc] if len(doc) else doc
        at, to = _trimmed(data, at, to)
        keep = to > at
        self.doc, self.number = doc[keep], number[keep]
        self.starts, self.ends = at[keep], to[keep]
        self.data, self.raw = data, data.tobytes()
        digests = [xxhash.xxh3_64_intdigest(self.raw[x:y]) for x, y in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        self.node = np.array(digests, dtype=np.uint64).view(np.int64)

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the lines start and end, in code points."""
        inner = np.flatnonzero(self.data.view(np.int8) < -64)  # bytes 0x80 to 0xBF
        return self.starts - np.searchsorted(inner, self.starts), self.ends - np.searchsorted(inner, self.ends)

    def prefix(self) -> K.Prefix:
        """Of the chunk's code points."""
        cps = np.frombuffer(self.raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        return K.token_prefix(cps, raw=cps)

    def texts(self, which: np.ndarray) -> pa.Array:
        starts, ends = self.starts[which], self.ends[which]
        data = b"".join([self.raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _shingles(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each line's shingles; a shorter line is one shingle."""
    size = ends - starts
    n = np.maximum(size - SHINGLE + 1, 1)
    line = np.repeat(np.arange(len(starts)), n)
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n)
    at += np.arange(len(at))
    grams = K.gram_hashes(prefix, SHINGLE)
    if not len(grams):
        return K.range_hash(prefix, starts, ends), line
    short = np.flatnonzero(size < SHINGLE)
    at[first[short]] = 0  # may lie beyond the last gram
    h = grams[at]
    h[first[short]] = K.range_hash(prefix, starts[short], ends[short])
    return h, line


def one_permutation(h: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """MINIMA minima of each line: one hash deals the shingles to bins, each bin keeps its least.

    Empty bins borrow from the next filled one, marked with the distance.
    """
    sig = np.full(lines * MINIMA, EMPTY, dtype=np.uint32)
    place = h >> np.uint64(32)
    place *= np.uint64(MINIMA)
    place >>= np.uint64(32)
    place = place.view(np.int64)
    place += line * MINIMA
    value = h * np.uint64(0x9E3779B97F4A7C15)
    value >>= np.uint64(32)
    np.minimum.at(sig, place, np.minimum(value.astype(np.uint32), EMPTY - np.uint32(1)))
    sig = sig.reshape(lines, MINIMA)
    some = np.flatnonzero((sig == EMPTY).any(axis=1))
    own = sig[some]
    filled = np.where(np.concatenate([own, own], axis=1) != EMPTY, np.arange(2 * MINIMA, dtype=np.int16), np.int16(2 * MINIMA))
    source = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :MINIMA]  # each bin's next filled one, itself included
    step = (source - np.arange(MINIMA, dtype=np.int16)).astype(np.uint32)
    row, bin_ = np.nonzero((step > 0) & (source < 2 * MINIMA))
    own[row, bin_] = own[row, source[row, bin_] % MINIMA] * np.uint32(31) + step[row, bin_] * np.uint32(0x9E3779B1)
    sig[some] = own
    return sig


def line_sets(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, taken whole as one line; as minhash.shingle_sets."""
    points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    cps = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    h, doc = _shingles(K.token_prefix(cps), points[c.starts], points[c.ends])
    return distinct(h, doc, len(c))


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(2), CHUNK):
            lines = Lines(c)
            at, (starts, ends) = pa.array(c.first + lines.doc), lines.points()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.number), pa.array(ends - starts), pa.array(lines.node)], names=["id", "row", "line_no", "n_chars", "node"])


def _band_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, node = [np.zeros((0, BANDS), np.uint64)], [np.zeros(0, np.int64)]
            for c in K.chunks(batch.column(0), CHUNK):
                lines = Lines(c)
                first = np.sort(np.unique(lines.node, return_index=True)[1])  # in the order of the text
                if len(first):
                    starts, ends = lines.points()
                    hashes, line = _shingles(lines.prefix(), starts[first], ends[first])
                    h.append(band_hashes(one_permutation(hashes, line, len(first)), ROWS))
                    node.append(lines.node[first])
            yield pack_bands(np.concatenate(h).ravel(), np.repeat(np.concatenate(node), BANDS), buckets)

    return run


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(0), CHUNK):
            lines = Lines(c)
            first = np.sort(np.unique(lines.node, return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(lines.node[first]), lines.texts(first)], names=["node", "text"])


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Marks one line of each group of similar lines, over all documents.

    Lines are what newlines separate, trimmed of spaces and lower-cased (A-Z);
    lines without a word are not listed and stay.  Equal lines are one node
    (a 64-bit digest).  Lines are linked if their sets of 10-character shingles
    have a Jaccard similarity of ``percent`` or more (a shorter line is one
    shingle); candidates come from MinHash bands (16 of 3 minima), every
    candidate is verified on the full sets, and components are found by local
    union-find and star operations.  The line that comes first by id and line
    number is kept.

    Returns ``id_col, row_key, line_no, n_chars, keep_id, keep_line, kept``:
    one row per line with a word; ``line_no`` counts all lines from 0.  Null
    and empty texts have no lines.  A null id comes last.  Identical rows keep
    or lose the same lines.  Further columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col)["k1"].alias("row"), F.col(text_col).alias("text"))
    lines = materialize(base.mapInArrow(_line_batches, "id long, row long, line_no long, n_chars long, node long"), "lines")
    only = base.select("text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs, text_col) * BANDS // 200 // BUCKET_ROWS)
    members = band_members(only.mapInArrow(_band_batches(buckets), PACKED_DDL), buckets)

    def texts(needed: DataFrame, count: int) -> DataFrame:
        return prefilter(only.mapInArrow(_text_batches, "node long, text string"), needed, count).dropDuplicates(["node"]).join(needed, "node")

    named = linked_classes(members, texts, line_sets, percent=percent, block=BLOCK, what="lines")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "line_no")
    # a line that occurs once and is linked to none keeps itself: only the others are written and looked up
    several = lines.groupBy("node").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).join(named, "node", "left").where("n > 1 or component is not null")
    several = materialize(several.select("node", "place", F.coalesce("component", "node").alias("component")), "lines-several")
    least = materialize(several.groupBy("component").agg(F.min("place").alias("keep")), "lines-least")
    keep = materialize(several.join(least, "component").select("node", F.col("keep.id").alias("first_id"), F.col("keep.row").alias("first_row"), F.col("keep.line_no").alias("first_line")), "lines-keep")
    alone = F.col("first_row").isNull()
    same = (F.col("row") == F.col("first_row")) & (F.col("line_no") == F.col("first_line")) & F.col("id").eqNullSafe(F.col("first_id"))
    keep_id, keep_line = (F.when(alone, F.col(a)).otherwise(F.col(b)) for a, b in (("id", "first_id"), ("line_no", "first_line")))
    return lines.join(keep, "node", "left").select(F.col("id").alias(id_col), F.col("row").alias("row_key"), "line_no", "n_chars", keep_id.alias("keep_id"), keep_line.alias("keep_line"), (alone | same).alias("kept"))


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines that :func:`dedup_lines` does not keep taken out of the text; rows are told apart by id and 64-bit key."""
    gone = dedup_lines(docs, id_col=id_col, text_col=text_col, percent=percent).where("not kept").select(F.col(id_col).alias("gone_id"), "row_key", "line_no").distinct()
    gone = gone.groupBy("gone_id", "row_key").agg(F.collect_set("line_no").alias("gone_lines"))  # a document's own lines
    keyed = docs.withColumn("_key", document_key(id_col, text_col)["k1"]).alias("d")
    same = F.col("_key").eqNullSafe(F.col("row_key")) & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("gone_id"))
    keyed = keyed.join(gone, same, "left")
    lines = F.filter(F.split(F.col(f"d.{text_col}"), "\n", -1), lambda line, i: ~F.array_contains("gone_lines", i.cast("long")))
    text = F.when(F.col("gone_lines").isNull(), F.col(f"d.{text_col}")).otherwise(F.array_join(lines, "\n"))
    return keyed.select(*[text.alias(c) if c == text_col else F.col(f"d.{c}") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
