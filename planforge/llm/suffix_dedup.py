"""Byte-level deduplication by a distributed merge sort of suffixes that knows common prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .merging import compare, merge, run_lcp

LENGTH = 50
RESULT_DDL = "id long, n_units long, n_removed long, n_spans long, spans array<struct<start: long, length: long>>, kept binary"


def _sizes(n: int) -> type:
    return np.uint8 if n < 256 else np.uint16 if n < 65536 else np.uint32


def encode(spec: R.Spec, e: R.Entries, i: int, j: int) -> bytes:
    """A sorted run of suffixes, front-coded: of each only the bytes after those it shares with the one before."""
    after, right, left = e.after[i:j], e.right[i:j], e.left[i:j]
    lcp = np.minimum(run_lcp(np.stack(R.as_digits(after), axis=1)), spec.length)
    column = np.arange(spec.length)
    rest = after[(column >= lcp[:, None]) & (column < right[:, None])]
    before = e.before[i:j][np.arange(spec.width - 1) < left[:, None]]
    small = _sizes(spec.length)
    return R.pack(lcp.astype(small), right.astype(small), left.astype(np.uint8), e.doc[i:j], rest, before)


def decode(spec: R.Spec, blobs: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """(lcp, right, left, doc, bytes after, bytes before) of all runs end to end, and the runs' sizes."""
    got = [R.unpack(x) for x in blobs]
    lcp, right, left, doc, rest, before = (np.concatenate(x) for x in zip(*got, strict=True))
    lcp, right, left = lcp.astype(np.int64), right.astype(np.int64), left.astype(np.int64)
    n, column = len(lcp), np.arange(spec.length)
    after = np.full((n, spec.length), 0xFF, np.uint8)
    after[(column >= lcp[:, None]) & (column < right[:, None])] = rest
    rows = np.arange(n)
    for c in range(spec.length):  # a byte that was not sent is that of the last row that sent its own
        sent = np.maximum.accumulate(np.where(lcp <= c, rows, 0))
        after[:, c] = after[sent, c]
    back = np.full((n, spec.width - 1), 0xFF, np.uint8)
    back[np.arange(spec.width - 1) < left[:, None]] = before
    return [lcp, right, left, doc, after, back], [len(x[0]) for x in got]


def covered_windows(spec: R.Spec, runs: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Of each row the windows that a smaller document has: bit k stands for the window that starts k bytes before the suffix.

    In the merged order the suffixes that share ``length - k`` bytes lie next to
    each other, cut where a common prefix is shorter.  Those of them whose k
    bytes to the left agree as well have the window.
    """
    lcp, right, left, doc, after, back = runs
    n, length = len(doc), spec.length
    digits = np.stack(R.as_digits(after), axis=1)
    order, common = merge(digits, lcp, sizes)
    out = np.zeros(n, np.uint32)
    if spec.width > 1:
        columns = R.as_digits(back)
        by_left = R.sort_rows(columns)
        flat = np.stack(columns, axis=1)[by_left].ravel()
        agree = np.zeros(n, np.int64)
        agree[1:], _ = compare(flat, len(columns), np.arange(1, n), np.arange(n - 1), np.zeros(n - 1, np.int64))
    for k in range(spec.width):
        has = np.flatnonzero((left >= k) & (length - right <= k))
        if len(has) < 2:
            continue
        key = np.empty(n, np.int64)
        key[order] = np.cumsum(common < length - k)
        if k:
            other = np.empty(n, np.int64)
            other[by_left] = np.cumsum(agree < k)
            key = other * (n + 1) + key
        key = key[has]
        at = np.argsort(key, kind="stable")
        sorted_key = key[at]
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        d = doc[has[at]]
        least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
        out[has[at[least < d]]] |= np.uint32(1 << k)
    return out


def answer(spec: R.Spec, bucket: int, table: pa.Table) -> pa.Table:
    runs, sizes = decode(spec, table.column("blob").to_pylist())
    masks = covered_windows(spec, runs, sizes)
    return R.answer_rows(table.column("run").to_pylist(), bucket * 2 + 1, [R.pack(x) for x in np.split(masks, np.cumsum(sizes)[:-1])])


def result(spec: R.Spec, docs: pa.Table, flags: pa.Table) -> pa.Table:
    """One row per distinct row of the run: what is removed and what is left."""
    r, e, got = R.resolved(spec, docs, flags)
    masks = np.concatenate([np.zeros(0, np.uint32), *(x[0] for x in got)])[e.of]
    all_of = ((np.uint64(1) << (e.left[e.of] + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    all_of &= ~((np.uint64(1) << (spec.length - e.right[e.of]).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    masks = np.where(e.doc[e.of] < e.doc_of, all_of, masks)  # a smaller document of the same run has them all
    order = np.argsort(e.chunk, kind="stable")
    cut = np.searchsorted(e.chunk[order], np.arange(len(r.first)))
    out = []
    for number, c in enumerate(r.chunks()):
        mine = order[cut[number] : cut[number + 1]]
        gone = np.zeros(len(c.data), dtype=bool)
        starts = [e.pos[mine[(masks[mine] >> np.uint32(k)) & np.uint32(1) == 1]] - k for k in range(spec.width)]
        starts = np.concatenate(starts)
        if len(starts):
            gone = K.set_bits(len(c.data), starts, starts + spec.length)
        columns = R.id_column(r, c) | R.kept_text(spec, c, None, c.starts, c.ends, gone)
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[0] = edge[-1] = True
        edge[c.starts] = edge[c.ends] = True
        at = np.flatnonzero(edge)
        span = np.flatnonzero(gone[at[:-1]]) if len(gone) else np.zeros(0, np.int64)
        begin, size = at[span], at[span + 1] - at[span] if len(span) else span
        full = np.flatnonzero(c.ends > c.starts)  # documents of no byte own nothing
        of = full[R.owners(begin, c.starts[full])] if len(full) else begin
        columns["spans"] = R.lists(np.bincount(of, minlength=len(c)), {"start": begin - c.starts[of], "length": size})
        out.append(pa.table([columns[n] for n in NAMES], names=NAMES))
    return pa.concat_tables(out)


NAMES = ["id", "n_units", "n_removed", "n_spans", "spans", "kept", "copies"]


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = 1024) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string of a document with a smaller id.

    A distributed merge sort of suffixes.  Every ``length``-byte string holds a
    winnowed anchor, and the suffixes that start at anchors are sorted, each to
    ``length`` bytes (:mod:`planforge.llm.repeats`):

    1. a sift by hashes drops anchors that only one document has, as the first
       step of a prefix-doubling string sort does;
    2. each run of documents sorts its suffixes, puts equal ones together, and
       sends them front-coded: only the bytes not shared with the suffix before;
    3. a bucket merges the sorted runs with loser trees that carry common-prefix
       lengths and never look at a known prefix again
       (:mod:`planforge.llm.merging`);
    4. common prefixes of neighbours in the merged order, and the bytes left of
       the anchors, decide on the bytes themselves which strings repeat.

    Returns ``id_col, n_units, n_removed, n_spans, spans, kept``: one row per
    input row; ``spans`` (start, length) are the maximal removed runs and
    ``kept`` is binary, since a cut may fall inside a code point.

    Null text is empty.  A null id is larger than every other id.  Rows that
    share an id do not remove each other's text; repeated rows have repeated
    results.  Texts shorter than ``length`` bytes stay whole.  An empty table
    gives no rows.  Further columns of ``docs`` are not read.  ``hot``: an anchor with more
    surroundings is dealt string by string; the result is the same.
    """
    out = R.find_repeats(docs, id_col=id_col, text_col=text_col, unit="byte", length=length, encode=encode, answer=answer, result=result, result_ddl=RESULT_DDL, hot=hot)
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same result from every 50-byte string itself, as hexadecimal text cut from pieces of 1,000 bytes.
ORACLE = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT doc_id, offs, substr(h, CAST(2 * offs + 1 AS BIGINT), 2098) AS piece
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 1000)) AS offs FROM texts)
),
strings AS (
  SELECT doc_id, offs + i AS p, substr(piece, CAST(2 * i + 1 AS BIGINT), 100) AS s
  FROM (SELECT doc_id, offs, piece, unnest(range(0, least(length(piece) // 2 - 49, 1000))) AS i FROM pieces)
),
first_in AS (SELECT s, min(doc_id) AS owner FROM strings GROUP BY s),
gone AS (SELECT doc_id, p FROM strings JOIN first_in USING (s) WHERE owner < doc_id),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 50, true) AS new FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM numbered GROUP BY doc_id, span),
borders AS (
  SELECT doc_id, b, e FROM spans
  UNION ALL SELECT doc_id, length(h) // 2, NULL FROM texts
),
gaps AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e NULLS LAST), 0) AS a FROM borders),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a, b) AS k
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
),
counts AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
