"""Repeats across documents: what suffix-array and substring deduplication share.

A window (``length`` consecutive bytes or words of one document) is *repeated*
in document D if it also starts in a document with a smaller id.  The units of
both operators are entries, found and exchanged as follows:

* every window has an *anchor*, the ``seed``-gram with the least hash among
  those inside the window; equal windows have equal anchors at equal places
  (winnowing), so only anchors and what surrounds them need to be compared;
* documents are dealt to runs by a hash of their content; equal rows of a batch
  are put together first, so one repeated row does not fill a run;
* round ``sift`` asks, by 40-bit hashes, which anchors several documents have.
  A chance collision only lets an anchor through;
* round ``match`` exchanges the entries of those anchors: the units of all
  windows around the anchor, equal ones of a run once, with their smallest
  document.  A bucket compares the entries unit by unit (bytes, or 64-bit
  hashes of single words) and answers each run, entry by entry.  How it does
  that is the operator's own method;
* an anchor with more than ``hot`` different surroundings is taken apart: each
  of its windows is an entry by itself, dealt by the window's hash.  So neither
  a hot passage nor a hot phrase fills one bucket.

Anchors are dealt to buckets by a second hash, since an anchor's own hash is a
minimum and so mostly small.  A run sends a bucket at most one packed row and
none if it has nothing, so the exchange has at most as many rows as entries.
Runs depend on the rows' content alone: a lost executor's tasks can be repeated
with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BLOB = "run long, bucket long, blob binary"
NO_DOC = np.iinfo(np.int64).max
ALONE, SHARED, HOT = 0, 1, 2
MOST = 255  # surroundings of an anchor that a run counts


@dataclass(frozen=True)
class Spec:
    """What a window is: ``unit`` byte or word, and its length."""

    unit: str
    length: int
    buckets: int
    hot: int = 1024

    @property
    def width(self) -> int:
        """Seeds in a window, and so windows around an anchor."""
        return max(1, min(26, self.length // 2))

    @property
    def seed(self) -> int:
        return self.length - self.width + 1


# --- packing -----------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed together."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if len(c) else b""
        out.append(c.dtype.str.encode().ljust(4) + len(c).to_bytes(8, "little") + planes)
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        dtype, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    return out


def spread(h: np.ndarray) -> np.ndarray:
    """A second, even hash of hashes of which minima were taken."""
    return K.mix(K.mix(h ^ np.uint64(0xA0761D6478BD642F)))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def blob_rows(run: int, pieces: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"run": pa.array([run] * len(pieces), pa.int64()), "bucket": pa.array([b for b, _ in pieces], pa.int64()), "blob": pa.array([x for _, x in pieces], pa.binary())})


def sort_rows(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several columns; only rows that are still tied look at the next column."""
    order = np.argsort(columns[0], kind="stable")
    value = columns[0][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    for c in columns[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        rows = order[at]
        rows = rows[np.lexsort((c[rows], group))]
        order[at] = rows
        value = c[rows]
        new[at[1:]] |= (value[1:] != value[:-1]) | (group[1:] != group[:-1])
    return order


# --- one run -------------------------------------------------------------------


def owners(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The document of each position; both sorted."""
    count = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return np.repeat(np.arange(len(starts)), count)


class Run:
    """The documents of one run and their anchors.

    Per anchor: ``fp`` its hash, ``ctx`` the hash of its surroundings, ``doc``
    the document's id, ``row``, ``pos`` its place in the chunk's units, ``at``
    its place in the document, and ``most``, ``least``: the units that the
    farthest and the nearest of its windows have to the left of it.
    """

    FIELDS = (("fp", np.uint64), ("ctx", np.uint64), ("doc", np.int64), ("row", np.int64), ("pos", np.int64), ("at", np.int64), ("most", np.int64), ("least", np.int64))

    def __init__(self, spec: Spec, docs: pa.Table) -> None:
        self.spec = spec
        self.ids = docs.column("id").fill_null(NO_DOC).to_numpy().astype(np.int64)
        self.copies = docs.column("copies").to_numpy()
        self.text = docs.column("text")
        self.first = [0]  # anchor of each chunk
        found = [self._anchors(c) for c in self.chunks()]
        for i, (name, dtype) in enumerate(self.FIELDS):
            setattr(self, name, np.concatenate([np.zeros(0, dtype), *(x[i] for x in found)]))

    def chunks(self):
        return K.chunks(self.text)

    def units(self, c: K.Chunk):
        """(units, prefix, documents' starts, ends, words) of a chunk: its bytes, or the hashes of its words."""
        if self.spec.unit == "byte":
            return c.data, K.byte_prefix(c.data), c.starts, c.ends, None
        w = K.words(c)
        tokens = K.word_hashes(c.data, w)
        return tokens, K.token_prefix(tokens), w.first[:-1], w.first[1:], w

    def _anchors(self, c: K.Chunk):
        s = self.spec
        units, prefix, starts, ends, _ = self.units(c)
        n = len(units)
        tail = np.zeros(n + 1, dtype=np.int32)  # the last length - 1 positions of a document start no window
        some = ends > starts
        np.add.at(tail, np.maximum(starts, ends - s.length + 1)[some], 1)
        np.add.at(tail, ends[some], -1)
        grams = K.gram_hashes(prefix, s.seed)
        a, win, win_end = K.minimizers(grams, np.cumsum(tail[:n]) == 0, s.width)
        self.first.append(self.first[-1] + len(a))
        of = owners(a, starts)
        ctx = K.range_hash(prefix, win, win_end - 1 + s.length, digests=False)  # only counted
        return grams[a], ctx, self.ids[c.first + of], c.first + of, a, a - starts[of], a - win, a - (win_end - 1)


def units_around(units: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, most_left: int, most_right: int, pad) -> tuple[np.ndarray, np.ndarray]:
    """(units from pos on, units before pos, the nearest first); beyond ``left`` and ``right`` there is ``pad``."""
    i, j = np.arange(most_right), np.arange(most_left)
    after = units[np.minimum(pos[:, None] + i, len(units) - 1)]
    after[i >= right[:, None]] = pad
    before = units[np.maximum(pos[:, None] - 1 - j, 0)]
    before[j >= left[:, None]] = pad
    return after, before


# --- round sift ------------------------------------------------------------------


def _key(r: Run) -> np.ndarray:
    return spread(r.fp) >> np.uint64(24)


def _sift_keys(r: Run):
    """Sorted distinct 40-bit keys of the anchors, surroundings of each, whether several documents have it."""
    key = _key(r)
    order = np.lexsort((r.ctx, key))
    k, d, x = key[order], r.doc[order], r.ctx[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    other = new.copy()
    other[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(k) else np.zeros(0, bool)
    kinds = np.minimum(np.add.reduceat(other.astype(np.int64), first), MOST).astype(np.uint8) if len(k) else np.zeros(0, np.uint8)
    return k[first], kinds, several


def sift_send(spec: Spec, run: int, docs: pa.Table) -> pa.Table:
    keys, kinds, several = _sift_keys(Run(spec, docs))
    cut = np.searchsorted(bucket_of(keys << np.uint64(24), spec.buckets), np.arange(spec.buckets + 1))
    return blob_rows(run, [(b, pack(np.diff(keys[i:j], prepend=np.uint64(0)), kinds[i:j], np.packbits(several[i:j]))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j])


def sift_answer(spec: Spec, bucket: int, table: pa.Table) -> pa.Table:
    runs = table.column("run").to_pylist()
    got = [unpack(x) for x in table.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in got]
    key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
    several = np.concatenate([np.unpackbits(x[2])[:n] for x, n in zip(got, sizes, strict=True)])
    kinds = np.concatenate([x[1] for x in got]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    count = np.diff(np.append(first, len(k)))
    shared = (count > 1) | (np.maximum.reduceat(several[order], first) > 0)
    status = np.where(shared, np.where(np.add.reduceat(kinds[order], first) > spec.hot, HOT, SHARED), ALONE).astype(np.uint8)
    back = np.empty(len(k), np.uint8)
    back[order] = np.repeat(status, count)
    return answer_rows(runs, bucket * 2, [pack(x) for x in np.split(back, np.cumsum(sizes)[:-1])])


def answer_rows(runs: list[int], bucket: int, blobs: list[bytes]) -> pa.Table:
    return pa.table({"run": pa.array(runs, pa.int64()), "bucket": pa.array([bucket] * len(runs), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _status(r: Run, answers: dict[int, list[np.ndarray]]) -> np.ndarray:
    _, of = np.unique(_key(r), return_inverse=True)
    return np.concatenate([np.zeros(0, np.uint8), *(x[0] for _, x in sorted(answers.items()))])[of]


def answers_of(flags: pa.Table) -> tuple[dict[int, list[np.ndarray]], dict[int, list[np.ndarray]]]:
    """Answers of the two rounds by bucket; a bucket's number holds the round in its lowest bit."""
    out: tuple[dict, dict] = ({}, {})
    for bucket, blob in zip(flags.column("bucket").to_pylist(), flags.column("blob").to_pylist(), strict=True):
        out[bucket % 2][bucket // 2] = unpack(blob)
    return out


# --- round match -------------------------------------------------------------------


@dataclass
class Entries:
    """What a run sends: distinct surroundings of shared anchors and distinct windows of hot ones.

    Rows are sorted by bucket, then by their units.  ``after`` are the units
    from the anchor on, ``before`` those to its left, nearest first; ``right``
    and ``left`` say how many count.  ``most`` (equal to ``left``) and ``least``
    bound the windows.  ``doc`` is the smallest document, ``at`` its place.
    ``of`` maps the run's occurrences (``chunk_pos``, ``row``, ``doc_of``) to rows.
    """

    bucket: np.ndarray
    after: np.ndarray
    before: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    of: np.ndarray
    chunk: np.ndarray
    pos: np.ndarray
    row: np.ndarray
    doc_of: np.ndarray
    at_of: np.ndarray


def as_digits(after: np.ndarray) -> list[np.ndarray]:
    """Columns in which rows of units compare: big-endian 8-byte digits, or the units themselves."""
    if after.dtype != np.uint8:
        return [np.ascontiguousarray(after[:, i]) for i in range(after.shape[1])]
    n, w = after.shape
    wide = np.full((n, -(-w // 8) * 8), 0xFF, np.uint8)
    wide[:, :w] = after
    digits = wide.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(digits[:, i]) for i in range(digits.shape[1])]


def entries_of(r: Run, status: np.ndarray) -> Entries:
    s = r.spec
    pad, dtype = (np.uint8(0xFF), np.uint8) if s.unit == "byte" else (np.uint64(0), np.uint64)
    parts = []
    for number, c in enumerate(r.chunks()):
        units, prefix, *_ = r.units(c)
        i, j = r.first[number], r.first[number + 1]
        at = i + np.flatnonzero(status[i:j] == SHARED)
        if len(at):
            parts.append((np.full(len(at), number), r.pos[at], r.most[at], s.length - r.least[at], r.row[at], r.doc[at], r.at[at], spread(r.fp[at]), *units_around(units, r.pos[at], r.most[at], s.length - r.least[at], s.width - 1, s.length, pad)))
        at = i + np.flatnonzero(status[i:j] == HOT)
        if len(at):  # each window by itself
            n = r.most[at] - r.least[at] + 1
            of = np.repeat(at, n)
            k = r.most[of] - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            start, zero, full = r.pos[of] - k, np.zeros(len(of), np.int64), np.full(len(of), s.length)
            parts.append((np.full(len(of), number), start, zero, full, r.row[of], r.doc[of], r.at[of] - k, spread(K.range_hash(prefix, start, start + s.length)), *units_around(units, start, zero, full, s.width - 1, s.length, pad)))
    if not parts:
        z = np.zeros(0, np.int64)
        return Entries(z, np.zeros((0, s.length), dtype), np.zeros((0, s.width - 1), dtype), z, z, z, z, z, z, z, z, z, z)
    chunk, pos, left, right, row, doc, at, key, after, before = (np.concatenate(x) for x in zip(*parts, strict=True))
    bucket = bucket_of(key, s.buckets)
    digits, back = as_digits(after), as_digits(before) if s.width > 1 else []
    columns = [bucket, *digits, *back, left, right, doc, at]
    order = sort_rows(columns)
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for x in columns[:-2]:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    first = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return Entries(bucket[first], after[first], before[first], left[first], right[first], doc[first], at[first], of, chunk, pos, row, doc, at)


def match_send(spec: Spec, run: int, docs: pa.Table, flags: pa.Table, encode: Callable[[Spec, Entries, int, int], bytes]) -> pa.Table:
    r = Run(spec, docs)
    e = entries_of(r, _status(r, answers_of(flags)[0]))
    cut = np.searchsorted(e.bucket, np.arange(spec.buckets + 1))
    return blob_rows(run, [(b, encode(spec, e, i, j)) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j])


def resolved(spec: Spec, docs: pa.Table, flags: pa.Table) -> tuple[Run, Entries, list[list[np.ndarray]]]:
    """The run, its entries and the answers to them in their order."""
    r = Run(spec, docs)
    sift, match = answers_of(flags)
    return r, entries_of(r, _status(r, sift)), [x for _, x in sorted(match.items())]


# --- result ------------------------------------------------------------------------


def kept_text(spec: Spec, c: K.Chunk, word: K.Words | None, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> dict[str, pa.Array]:
    """n_units, n_removed, n_spans and kept of a chunk's documents; ``gone`` marks the removed units."""
    rows, n = len(c), len(gone)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[ends] - total[starts]
    opening = gone.copy()
    if n:
        opening[1:] &= ~gone[:-1]
        head = starts[(starts < n) & (starts < ends)]
        opening[head] |= gone[head]
    opened = np.concatenate([[0], np.cumsum(opening)])
    if word is None:
        kept, sizes = c.data[~gone], (ends - starts) - removed
    else:  # kept words joined by one space
        w = np.flatnonzero(~gone)
        d = word.doc[w]
        size = word.ends[w] - word.starts[w] + 1
        to = np.cumsum(size) - size
        source = np.repeat(word.starts[w] - to, size) + np.arange(int(size.sum()))
        kept = c.data[np.minimum(source, max(0, len(c.data) - 1))] if len(c.data) else c.data
        space = to + size - 1
        kept[space] = 0x20
        final = np.append(d[1:] != d[:-1], True)[: len(d)]
        keep = np.ones(len(kept), bool)
        keep[space[final]] = False
        kept = kept[keep]
        sizes = np.bincount(d, weights=size, minlength=rows).astype(np.int64)
        sizes -= np.bincount(d, minlength=rows) > 0
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(kept).tobytes())])
    return {"n_units": pa.array(ends - starts), "n_removed": pa.array(removed), "n_spans": pa.array(opened[ends] - opened[starts]), "kept": binary}


def lists(counts: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def id_column(r: Run, c: K.Chunk) -> dict[str, pa.Array]:
    ids = r.ids[c.first : c.first + len(c)]
    return {"id": pa.array(ids, mask=ids == NO_DOC), "copies": pa.array(r.copies[c.first : c.first + len(c)], pa.int64())}


# --- Spark -------------------------------------------------------------------------


UNKNOWN = 1 << 60  # Catalyst's answer for sources that cannot tell their size


def plan_bytes(df: DataFrame, text_col: str) -> int:
    """Catalyst's estimate of the input in bytes (a scan's file size); counted where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < UNKNOWN else df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def _together(batches):
    """Puts equal rows (id, text) of a batch together; ``h`` is a hash of both that finds them."""
    for batch in batches:
        h = batch.column(0).to_numpy()
        order = np.argsort(h, kind="stable")
        if (h[order[1:]] != h[order[:-1]]).all():
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(len(h), np.int64))], names=["h", "id", "text", "copies"])
        else:
            t = pa.Table.from_batches([batch]).group_by(["h", "id", "text"]).aggregate([([], "count_all")])
            yield from t.select(["h", "id", "text", "count_all"]).rename_columns(["h", "id", "text", "copies"]).cast(pa.schema([batch.schema.field(0), batch.schema.field(1), batch.schema.field(2), ("copies", pa.int64())])).combine_chunks().to_batches()


def find_repeats(docs: DataFrame, *, id_col: str, text_col: str, unit: str, length: int, encode: Callable, answer: Callable, result: Callable, result_ddl: str, run_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20, hot: int = 1024) -> DataFrame:
    """One row of ``result_ddl`` for every row of ``docs``.

    ``encode`` packs a bucket's share of a run's entries, ``answer`` answers a
    bucket's blobs, ``result`` makes a run's rows.  ``run_bytes`` and
    ``bucket_bytes``: file bytes whose documents make one run, and whose entries
    one bucket.  Both set how much a task holds, never what is found.
    """
    if length < 1:
        raise ValueError("a window has at least one unit")
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(docs, text_col)
    runs, buckets = max(least, size // run_bytes + 1), max(least, size // bucket_bytes + 1)
    spec = Spec(unit, length, buckets, hot)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.select(F.xxhash64("id", "text").alias("h"), "id", "text").mapInArrow(_together, "h long, id long, text string, copies long")
    base = base.select(F.pmod("h", F.lit(runs)).alias("run"), "id", "text", "copies").repartition(runs, "run")

    def answered(sent: DataFrame, fn) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lambda key, t: fn(spec, key[0].as_py(), t), BLOB)

    def cogrouped(flags: DataFrame, fn, schema: str) -> DataFrame:
        return base.groupBy("run").cogroup(flags.groupBy("run")).applyInArrow(fn, schema)

    sifted = answered(base.groupBy("run").applyInArrow(lambda key, t: sift_send(spec, key[0].as_py(), t), BLOB), sift_answer)
    matched = answered(cogrouped(sifted, lambda key, t, f: match_send(spec, key[0].as_py(), t, f, encode), BLOB), answer)
    out = cogrouped(sifted.union(matched), lambda key, t, f: result(spec, t, f), result_ddl + ", copies long")
    columns = [c for c in out.columns if c != "copies"]
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
