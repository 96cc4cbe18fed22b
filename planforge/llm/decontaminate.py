"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

OVERLAP = 13  # words that an overlap needs, or the whole item if it is shorter
TOLERANCE = 0.8  # share of equal words in it
#: Fixed masks over consecutive words by the item's words: 1 compares a word, 0 ignores it.
#: Every overlap by OVERLAP and TOLERANCE matches one (tests enumerate the patterns).
SHORT_MASKS = {5: ("10111", "11011", "11101"), 6: ("1111", "111011", "110111")}
MASKS = ("1111", "111011")  # of items of 7 words and more
SEEDS = 2  # that an item has for each word at most
BROADCAST_SEEDS = 1 << 20  # seeds (16 bytes each) that are sent to every executor
CHECKED = 1 << 20  # words compared at once on the diagonals of hits


def least_equal(n: int, tolerance: float) -> int:
    """Equal words that a stretch of ``n`` words needs."""
    return math.ceil(tolerance * n - 1e-9)


@cache
def masks_of(length: int, overlap: int = OVERLAP, tolerance: float = TOLERANCE) -> tuple[str, ...]:
    """Masks of which every overlap with an item of ``length`` words matches one.

    Under other parameters than the module's, one mask compares as many
    consecutive words as stay equal between substitutions in any overlap.
    """
    if length < 1:
        return ()
    if (overlap, tolerance) == (OVERLAP, TOLERANCE):
        return ("1" * length,) if length < 5 else SHORT_MASKS.get(length, MASKS)
    sizes = [length] if length < overlap else range(overlap, overlap + 1000)  # more changes in longer ones leave longer runs
    return ("1" * max(1, min(-(-least_equal(n, tolerance) // (n - least_equal(n, tolerance) + 1)) for n in sizes)),)


def _lower_hashes(chunk: K.Chunk) -> tuple[K.Words, np.ndarray]:
    w = K.words(chunk)
    return w, K.word_hashes(K.LOWER[chunk.data], w)


def spaced_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash at each position of the words that the mask compares."""
    n = len(tokens) - len(mask) + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += tokens[i : i + n] if n > 0 else out
    return K.mix(out + np.uint64(int(mask, 2)))


def _seeds(w: K.Words, tokens: np.ndarray, masks: Iterable[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask, hash, document of the chunk, word position in the document) for each mask; shorter texts have none."""
    doc = w.doc
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        if n > 0:
            at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
            yield mask, spaced_hashes(tokens, mask)[at], doc[at], at - w.first[doc[at]]


def _item_seeds(w: K.Words, tokens: np.ndarray, overlap: int, tolerance: float) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """As _seeds, of items: each has the masks of its own length."""
    sizes = np.minimum(w.counts, max(overlap, 7))
    of = {int(n): masks_of(int(n), overlap, tolerance) for n in np.unique(sizes)}
    for mask, h, item, pos in _seeds(w, tokens, sorted({m for ms in of.values() for m in ms})):
        own = np.isin(sizes[item], [n for n, ms in of.items() if mask in ms])
        yield mask, h[own], item[own], pos[own]


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, overlap: int, tolerance: float) -> tuple[int, int, int]:
    """Longest stretch on one diagonal with enough equal words: (words, equal words, start in doc) or zeros.

    ``shift``: position in the document minus position in the item.  A stretch
    starts and ends with an equal word and keeps ``tolerance`` of its words equal.
    """
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    at = np.flatnonzero(same)
    need = min(overlap, len(item))
    if len(at) < least_equal(need, tolerance):
        return 0, 0, 0
    # longest i..j with equal words >= tolerance * length: rise of equal - tolerance * position
    rise = np.concatenate([[0], np.cumsum(same)]) - tolerance * np.arange(len(same) + 1) + 1e-9 * np.arange(len(same) + 1)
    best = (0, 0, 0)
    start_rise = rise[at]
    order = np.minimum.accumulate(start_rise)
    for j in at[::-1]:  # from the right: the first start low enough gives the longest
        if j + 1 < best[0]:
            break
        i = int(np.searchsorted(-order, -rise[j + 1], side="left"))
        if i < len(at) and at[i] <= j and j + 1 - at[i] > best[0]:
            n = int(j + 1 - at[i])
            best = (n, int(same[at[i] : j + 1].sum()), int(at[i] + lo))
    return best if best[0] >= need else (0, 0, 0)


class _Index:
    """The benchmark's seeds, sorted, with a bitmap in front of the binary search."""

    def __init__(self, items: pa.Table, overlap: int, tolerance: float, bits: int = 20) -> None:
        self.ids = items.column("item_id").to_pylist()
        self.tokens: list[np.ndarray] = []
        h, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        masks = set()
        for c in K.chunks(items.column("text")):
            w, tokens = _lower_hashes(c)
            self.tokens += [tokens[w.first[d] : w.first[d + 1]] for d in range(len(c))]
            for mask, hh, d, p in _item_seeds(w, tokens, overlap, tolerance):
                masks.add(mask)
                h.append(hh)
                item.append(d + c.first)
                pos.append(p)
        self.masks = sorted(masks)
        h, item, pos = np.concatenate(h), np.concatenate(item), np.concatenate(pos)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order], item[order], pos[order]
        self.bits = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[self.hash >> self.bits] = True
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.tokens])
        self.counts = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.least = np.array([least_equal(min(overlap, n), tolerance) for n in self.counts.tolist()], dtype=np.int64)

    def hits(self, w: K.Words, tokens: np.ndarray) -> np.ndarray:
        """Distinct rows (document, item, shift) with as many equal words on the diagonal as an overlap needs."""
        out = []
        for _, h, doc, pos in _seeds(w, tokens, self.masks):
            at = np.flatnonzero(self.bitmap[h >> self.bits])
            lo = np.searchsorted(self.hash, h[at], side="left")
            n = np.searchsorted(self.hash, h[at], side="right") - lo
            rows = np.repeat(np.arange(len(at)), n)
            seed = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append(np.stack([doc[at[rows]], self.item[seed], pos[at[rows]] - self.pos[seed]], axis=1))
        rows = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
        return rows[self._enough(w, tokens, *rows.T)]

    def _enough(self, w: K.Words, tokens: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        lo = np.maximum(0, shift)
        n = np.minimum(w.counts[doc], self.counts[item] + shift) - lo  # over 0, as a seed lies there
        equal, ends, i = np.zeros(len(n), np.int64), np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + CHECKED, side="right")))
            begin = np.cumsum(n[i:j]) - n[i:j]
            along = np.arange(int(n[i:j].sum())) - np.repeat(begin, n[i:j])
            left = np.repeat(w.first[doc[i:j]] + lo[i:j], n[i:j]) + along
            right = np.repeat(self.first[item[i:j]] + lo[i:j] - shift[i:j], n[i:j]) + along
            equal[i:j] = np.add.reduceat((tokens[left] == self.flat[right]).astype(np.int64), begin)
            i = j
        return equal >= self.least[item]


HITS = "id long, n_items long, item_id long, start long, n_words long, n_equal long"
HIT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("id", "n_items", "item_id", "start", "n_words", "n_equal")])


def _verify(doc: np.ndarray, pairs: list[tuple[int, np.ndarray, int]], overlap: int, tolerance: float):
    """(items, best item, start, words, equal words) over candidates (item id, item words, shift), or None."""
    found: dict[int, tuple[int, int, int]] = {}
    for item, tokens, shift in pairs:
        got = best_overlap(doc, tokens, shift, overlap, tolerance)
        if got[0] and got > found.get(item, (0, 0, 0)):
            found[item] = got
    if not found:
        return None
    item = min(found, key=lambda i: (-found[i][0], -found[i][1], i))
    n, equal, start = found[item]
    return len(found), item, start, n, equal


def _scan(batches: Iterator[pa.RecordBatch], index: _Index, overlap: int, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for c in K.chunks(batch.column(1)):
            w, tokens = _lower_hashes(c)
            hits = index.hits(w, tokens)
            for d in np.unique(hits[:, 0]):
                pairs = [(index.ids[i], index.tokens[i], int(s)) for _, i, s in hits[hits[:, 0] == d]]
                got = _verify(tokens[w.first[d] : w.first[d + 1]], pairs, overlap, tolerance)
                if got:
                    n, item, *rest = got
                    rows.append((ids[c.first + int(d)].as_py(), n, item, *rest))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], schema=HIT_SCHEMA)


def _seed_rows(seeds):
    """(h, row, pos) of each text's seeds; ``seeds`` makes them of its words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for c in K.chunks(batch.column(1)):
                for _, h, doc, pos in seeds(*_lower_hashes(c)):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[c.first + doc], pa.int64()), pa.array(pos, pa.int64())], names=["h", "row", "pos"])

    return rows


def _pair_check(overlap: int, tolerance: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, item, text, item_text, shifts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                t = [_lower_hashes(c)[1] for c in K.chunks(pa.array([text, item_text], pa.large_string()), 1)]
                got = _verify(t[0], [(item, t[1], s) for s in shifts], overlap, tolerance)
                if got:
                    rows.append((row, *got))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], schema=HIT_SCHEMA)

    return check


def _joined(base: DataFrame, bench: DataFrame, overlap: int, tolerance: float) -> DataFrame:
    """The way beyond the broadcast bound: a shuffled join of training and benchmark hashes.

    The benchmark's distinct hashes go into a join that leaves only documents'
    seeds that some item has; each (document, item) is verified once.
    """
    sizes = [r.n for r in bench.select(F.least(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(max(overlap, 7))).alias("n")).distinct().collect()]
    masks = sorted({m for n in sizes for m in masks_of(n, overlap, tolerance)})
    keyed = base.withColumn("row", F.xxhash64("id", "text"))
    items = bench.select("item_id", "text").mapInArrow(_seed_rows(lambda w, t: _item_seeds(w, t, overlap, tolerance)), "h long, row long, pos long").withColumnsRenamed({"row": "item_id", "pos": "item_pos"})
    hits = keyed.select("row", "text").mapInArrow(_seed_rows(lambda w, t: _seeds(w, t, masks)), "h long, row long, pos long").join(items, "h").groupBy("row", "item_id").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    pairs = hits.join(keyed.dropDuplicates(["row"]), "row").join(bench.withColumnRenamed("text", "item_text"), "item_id")
    checked = pairs.select("row", "item_id", "text", "item_text", "shifts").mapInArrow(_pair_check(overlap, tolerance), HITS.replace("id long,", "row long,", 1))
    best = checked.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.min(F.struct(-F.col("n_words"), -F.col("n_equal"), "item_id", "start")).alias("m"))
    best = best.select("row", "n_items", "m.item_id", "m.start", (-F.col("m.col1")).alias("n_words"), (-F.col("m.col2")).alias("n_equal"))
    return keyed.select("id", "row").join(best, "row").drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", overlap: int = OVERLAP, tolerance: float = TOLERANCE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The documents that hold a benchmark passage, substitutions tolerated.

    Words are lower-cased (A-Z).  Every position of every document is hashed
    under each mask and joined with the benchmark's hashes; around a hit the
    two texts are laid side by side and the longest stretch with at least
    ``tolerance`` of its words equal must have ``overlap`` words, or all words
    of a shorter item.  Every such stretch has a hit (:func:`masks_of`), so that
    none is lost; both ways below have the same candidates.

    The benchmark is sent to all executors if it has at most
    ``broadcast_seeds`` words (counted first); beyond that both sides' hashes
    are shuffled into a join.

    Returns ``id_col, n_items, item_id, start, n_words, n_equal``: one row per
    contaminated input row, with the longest overlap (ties: more equal words,
    then the smaller item).  Null texts and items, and texts without words,
    match nothing.  Repeated rows give repeated results; items with the same
    id count once.  An empty table on either side gives no rows.  Further columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null and item_id is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size * SEEDS // 2 > broadcast_seeds:  # a word has a byte and a separator at least
        return _joined(base, bench, overlap, tolerance).select(F.col("id").alias(id_col), "n_items", "item_id", "start", "n_words", "n_equal")
    items = bench.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(items)
    out = base.mapInArrow(lambda batches: _scan(batches, _Index(sent.value, overlap, tolerance), overlap, tolerance), HITS)
    return out.withColumnRenamed("id", id_col)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
