"""Word-level deduplication by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R

LENGTH = 50
STEP = 1 << 15  # blocks compared at once
RESULT_DDL = "id long, n_units long, n_removed long, n_spans long, factors array<struct<start: long, length: long, ref_id: long, ref_start: long>>, kept binary"


def encode(spec: R.Spec, e: R.Entries, i: int, j: int) -> bytes:
    """Reference blocks of a run: their words as numbers in a list of the words' hashes."""
    after, before, left, right = e.after[i:j], e.before[i:j], e.left[i:j], e.right[i:j]
    words = np.concatenate([after[np.arange(spec.length) < right[:, None]], before[np.arange(spec.width - 1) < left[:, None]]])
    listed, number = np.unique(words, return_inverse=True)
    return R.pack(left.astype(np.uint8), right.astype(np.uint32), e.doc[i:j], e.at[i:j], np.diff(listed, prepend=np.uint64(0)), number.astype(np.uint32))


class Blocks:
    """The reference blocks of a bucket, indexed by what follows and what precedes their anchors.

    A block is the words of all windows around an anchor.  ``after`` and
    ``before`` hold them as numbers (0: none); ``rank`` orders the blocks by the
    words from the anchor on, ``seed_class`` numbers the anchors.
    """

    def __init__(self, spec: R.Spec, blobs: list[bytes]) -> None:
        got = [R.unpack(x) for x in blobs]
        self.spec, self.sizes = spec, [len(x[0]) for x in got]
        self.left, self.right, self.doc, self.at = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in range(4))
        lists = [np.cumsum(x[4], dtype=np.uint64) for x in got]
        listed, number = np.unique(np.concatenate(lists), return_inverse=True)
        number = (number + 1).astype(np.int32)  # 0 is no word
        cut = np.cumsum([len(x) for x in lists])
        n = len(self.left)
        self.after, self.before = np.zeros((n, spec.length), np.int32), np.zeros((n, spec.width - 1), np.int32)
        done = 0
        for x, first, size in zip(got, cut - [len(x) for x in lists], self.sizes, strict=True):
            words = number[first + x[5].astype(np.int64)]
            rows = slice(done, done + size)
            here = np.arange(spec.length) < self.right[rows, None]
            split = int(here.sum())
            a, b = self.after[rows], self.before[rows]
            a[here] = words[:split]
            b[np.arange(spec.width - 1) < self.left[rows, None]] = words[split:]
            done += size
        self.rank = np.empty(n, np.int64)
        self.rank[R.sort_rows([self.after[:, i] for i in range(spec.length)])] = np.arange(n)
        in_order = self.after[np.argsort(self.rank), : spec.seed]
        self.seed_class = np.cumsum(np.append(True, (in_order[1:] != in_order[:-1]).any(axis=1))[:n])[self.rank]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that two blocks share from the anchor on."""
        out = np.minimum(self.right[a], self.right[b])
        for i in range(0, len(a), STEP):
            differ = self.after[a[i : i + STEP]] != self.after[b[i : i + STEP]]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.spec.length)
            np.minimum(out[i : i + STEP], first, out=out[i : i + STEP])
        return out


def previous_smaller(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The nearest place before each with a smaller value in the same group, or -1; groups are contiguous."""
    n = len(value)
    start = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(n), 0))
    at = np.arange(n) - 1
    while True:
        bad = np.flatnonzero((at >= start) & (value[np.maximum(at, 0)] >= value))
        if not len(bad):
            break
        at[bad] = at[at[bad]]  # nothing between is smaller
    return np.where(at >= start, at, -1)


def parse(b: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of every block against the blocks of smaller documents: (block, words left of its anchor where it starts, length, reference block).

    All blocks step from left to right together.  At its place a block takes the
    longest match: in the order of what follows, among those that agree to the
    left, the nearest blocks of smaller documents before and after it share the
    most with it.  A factor must have ``length`` words.  The next place is the
    first window that is not inside the factor, so the windows across its end
    are checked; without a factor it is the next window.
    """
    spec, n = b.spec, len(b.left)
    place = b.left.copy()  # words left of the anchor at which the next window starts
    last = spec.length - b.right
    left_class = [b.seed_class]
    for k in range(1, spec.width):
        pair = left_class[-1] * (int(b.before[:, k - 1].max(initial=0)) + 1) + b.before[:, k - 1]
        left_class.append(np.unique(pair, return_inverse=True)[1])
    group = b.seed_class
    out = []
    for k in range(spec.width - 1, -1, -1):
        due = (place == k) & (k >= last)
        if not due.any():
            continue
        busy = np.zeros(int(group.max(initial=0)) + 1, dtype=bool)
        busy[group[due]] = True
        rows = np.flatnonzero(busy[group] & (b.left >= k) & (last <= k))
        rows = rows[np.lexsort((b.rank[rows], left_class[k][rows]))]
        doc, cls = b.doc[rows], left_class[k][rows]
        before = previous_smaller(doc, cls)
        after = previous_smaller(doc[::-1], cls[::-1])[::-1]
        after = np.where(after >= 0, len(rows) - 1 - after, -1)
        here = np.flatnonzero(due[rows])
        best, ref = np.zeros(len(here), np.int64), np.full(len(here), -1)
        for side in (before, after):
            other = side[here]
            ok = np.flatnonzero(other >= 0)
            size = b.common(rows[here[ok]], rows[other[ok]]) + k
            better = size > best[ok]
            best[ok[better]], ref[ok[better]] = size[better], rows[other[ok[better]]]
        # of the matches as long as the best, the smallest document among those with this window
        share = np.cumsum(np.append(True, (cls[1:] != cls[:-1]) | (b.common(rows[1:], rows[:-1]) < spec.length - k))) - 1 if len(rows) else cls
        first = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
        by_doc = np.lexsort((doc, share))
        least = rows[by_doc[first]][share[here]]
        found = best >= spec.length
        same = found & (b.doc[least] < b.doc[rows[here]])
        at = np.flatnonzero(same)
        equal = b.common(rows[here[at]], least[at]) + k == best[at]
        ref[at[equal]] = least[at[equal]]
        got = np.flatnonzero(found)
        out.append((rows[here[got]], np.full(len(got), k), best[got], ref[got]))
        place[rows[here]] = np.where(found, k - (best - spec.length + 1), k - 1)
    z = np.zeros(0, np.int64)
    block, start, size, ref = (np.concatenate([z, *x]) for x in zip(*out, strict=True)) if out else (z, z, z, z)
    order = np.lexsort((-start, block))
    return block[order], start[order], size[order], ref[order]


def answer(spec: R.Spec, bucket: int, table: pa.Table) -> pa.Table:
    b = Blocks(spec, table.column("blob").to_pylist())
    block, start, size, ref = parse(b)
    blobs, done = [], 0
    for n in b.sizes:
        i, j = np.searchsorted(block, [done, done + n])
        count = np.bincount(block[i:j] - done, minlength=n).astype(np.uint8)
        # a factor's reference starts as many words left of the reference's anchor
        blobs.append(R.pack(count, start[i:j].astype(np.uint8), size[i:j].astype(np.uint32), b.doc[ref[i:j]], b.at[ref[i:j]]))
        done += n
    return R.answer_rows(table.column("run").to_pylist(), bucket * 2 + 1, blobs)


def assemble(doc: np.ndarray, start: np.ndarray, size: np.ndarray, ref: np.ndarray, ref_start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The greedy parse of whole documents: (document, start, length, ref, ref_start) of factors, from those of their blocks.

    Factors of neighbouring blocks on one diagonal of one reference are one
    match; it ends in the block that has a longer one elsewhere.  At a place the
    match that reaches farthest is the factor; the next place is the first
    window that is not inside it.
    """
    if not len(doc):
        return doc, start, size, ref, ref_start
    diagonal = ref_start - start
    order = np.lexsort((start, diagonal, ref, doc))
    doc, start, size, ref, diagonal = doc[order], start[order], size[order], ref[order], diagonal[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (diagonal[1:] != diagonal[:-1]))
    lift = np.cumsum(new) * (int((start + size).max()) + 1)  # ends grow from group to group
    end = np.maximum.accumulate(start + size + lift)
    new[1:] |= start[1:] + lift[1:] > end[:-1]
    first = np.flatnonzero(new)
    end = (end - lift)[np.append(first[1:], len(doc)) - 1]
    doc, start, ref, diagonal = doc[first], start[first], ref[first], diagonal[first]
    order = np.lexsort((ref, -end, start, doc))
    out: list[tuple[int, int]] = []
    at, best, now = 0, -1, -1
    d, s, e = doc[order].tolist(), start[order].tolist(), end[order].tolist()
    n = len(order)
    i = 0
    while i < n or best >= 0:
        if best < 0:
            now, at, best = d[i], s[i], i
            i += 1
        while i < n and d[i] == now and s[i] <= at:  # matches that hold the window at this place
            if e[i] > e[best]:
                best = i
            i += 1
        out.append((best, at))
        at = e[best] - length + 1
        # matches that start up to there and reach farther hold the next window; otherwise the next match opens
        farther = -1
        while i < n and d[i] == now and s[i] <= at:
            if e[i] > e[best] and (farther < 0 or e[i] > e[farther]):
                farther = i
            i += 1
        best = farther
    pick, place = order[[x for x, _ in out]], np.array([p for _, p in out])
    return doc[pick], place, end[pick] - place, ref[pick], place + diagonal[pick]


NAMES = ["id", "n_units", "n_removed", "n_spans", "factors", "kept", "copies"]


def result(spec: R.Spec, docs: pa.Table, flags: pa.Table) -> pa.Table:
    """One row per distinct row of the run: its factors and what is left."""
    r, e, got = R.resolved(spec, docs, flags)
    z = np.zeros(0, np.int64)
    count, start, size, ref, ref_at = (np.concatenate([z, *(x[i] for x in got)]).astype(np.int64) for i in range(5))
    first = np.cumsum(count) - count
    local = e.doc[e.of] < e.doc_of  # a smaller document of the same run has the whole block
    n = np.where(local, 1, count[e.of]) if len(e.of) else z
    occurrence = np.repeat(np.arange(len(e.of)), n)
    entry, whole = e.of[occurrence], local[occurrence]
    at = np.arange(len(occurrence)) - np.repeat(np.cumsum(n) - n, n) + first[entry]
    at = np.minimum(at, max(len(start) - 1, 0))
    pick = (lambda x: x[at]) if len(start) else (lambda x: np.zeros(len(at), np.int64))
    back = np.where(whole, e.left[entry], pick(start))
    begin = e.at_of[occurrence] - back
    length = np.where(whole, e.left[entry] + e.right[entry], pick(size))
    who = np.where(whole, e.doc[entry], pick(ref))
    ref_start = np.where(whole, e.at[entry], pick(ref_at)) - back
    doc, begin, length, who, ref_start = assemble(e.row[occurrence], begin, length, who, ref_start, spec.length)
    out = []
    for c in r.chunks():
        _, _, starts, ends, word = r.units(c)
        i, j = np.searchsorted(doc, [c.first, c.first + len(c)])
        d = doc[i:j] - c.first
        total = int(word.first[-1])
        gone = K.set_bits(total, starts[d] + begin[i:j], starts[d] + begin[i:j] + length[i:j]) if j > i else np.zeros(total, dtype=bool)
        columns = R.id_column(r, c) | R.kept_text(spec, c, word, starts, ends, gone)
        columns["factors"] = R.lists(np.bincount(d, minlength=len(c)), {"start": begin[i:j], "length": length[i:j], "ref_id": who[i:j], "ref_start": ref_start[i:j]})
        out.append(pa.table([columns[n] for n in NAMES], names=NAMES))
    return pa.concat_tables(out)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = 1024) -> DataFrame:
    """Removes each word covered by a window of ``length`` words of a document with a smaller id.

    Relative Lempel-Ziv parsing.  The reference of a document is all documents
    with smaller ids, cut into blocks: the words of all windows around a
    winnowed anchor, so that every window lies in a block.  Blocks are dealt to
    buckets by their anchors and indexed there by what follows and precedes the
    anchor (:mod:`planforge.llm.repeats`, :class:`Blocks`).  Every block is
    factored greedily against the blocks of smaller documents, longest match
    first, and windows across the ends of factors are checked (:func:`parse`);
    neighbouring factors of a document are one factor where they follow the same
    reference (:func:`assemble`).  Only factors of ``length`` words and more count.

    Blocks are compared word by word, each word by a 64-bit hash.  No match
    rests on the hash of a whole window.

    Returns ``id_col, n_units, n_removed, n_spans, factors, kept``: one row per
    input row; a factor has its first word, the number of words, the document it
    refers to and the first word there; ``kept`` (binary UTF-8) is the words
    left, joined by one space.

    Null text has no words.  A null id is larger than every other id.  Rows
    that share an id do not remove each other's words; repeated rows have
    repeated results.  Shorter texts stay whole.  An empty table gives no rows.
    Further columns of ``docs`` are not read.  ``hot``: an anchor with more
    surroundings is dealt window by window; what is removed is the same.
    """
    out = R.find_repeats(docs, id_col=id_col, text_col=text_col, unit="word", length=length, encode=encode, answer=answer, result=result, result_ddl=RESULT_DDL, hot=hot)
    return out.withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same result from every window itself, its words joined by a space.
ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p + 1 : p + 50], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 49, 0))) AS p FROM texts)
),
first_in AS (SELECT s, min(doc_id) AS owner FROM windows GROUP BY s),
gone AS (SELECT doc_id, p FROM windows JOIN first_in USING (s) WHERE owner < doc_id),
covered AS (SELECT DISTINCT doc_id, p + i AS p FROM (SELECT doc_id, p, unnest(range(0, 50)) AS i FROM gone)),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
