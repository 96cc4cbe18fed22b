"""MinHash near-duplicate detection: banding, signature verification, exact check, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .banding import linked_classes, minima, prefilter, signature_members
from .storage import materialize, row_key

BLOCK = 256  # documents that a task compares with each other
BANDS, ROWS = 32, 4  # a pair at similarity 0.8 shares no band with probability 5e-8
_RNG = np.random.default_rng(77)
FACTORS = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (document, hash), sorted: (hash, document, first of each document)."""
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32 if docs > 65535 else np.uint16), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(docs + 1))


def shingle_sets(c: K.Chunk, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in order: (hash, document, first of each document).

    Words are lower-cased (A-Z).  A document with fewer words has one shingle,
    its whole sequence; one without words has none.
    """
    w = K.words(c)
    tokens = K.word_hashes(K.LOWER[c.data], w)
    prefix, counts = K.token_prefix(tokens), w.counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    n = len(tokens) - words + 1
    at = np.flatnonzero(w.doc[:n] == w.doc[words - 1 :]) if n > 0 else np.zeros(0, np.int64)
    doc = np.concatenate([w.doc[at], short])
    h = np.concatenate([K.range_hash(prefix, at, at + words), K.range_hash(prefix, w.first[short], w.first[short + 1])])
    return distinct(h, doc, len(c))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS minima of each set."""
    return minima(h, first, FACTORS, TERMS)


ROW = "struct<k1: bigint, k2: bigint>"
SET_DDL = f"id long, row {ROW}, n long, s1 long, s2 long, sig binary"


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                h, _, first = shingle_sets(c, words)
                n = np.diff(first)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h ^ np.uint64(k)), dtype=np.uint64)]) for k in (0x1234567, 0x89ABCDEF)]
                s1, s2 = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
                sig = signatures(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)), batch.column(1).slice(c.first, len(c)), pa.array(n), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "row", "n", "s1", "s2", "sig"])

    return run


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of a row's id and text."""
    return row_key(F.col(id_col).cast("long"), F.col(text_col))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, n, s1, s2, sig) of each row, and (s1, s2, id, row, node, component) of each distinct set.

    ``row`` and ``id`` are those of the smallest (id is null, id, row key) that
    has the set; ``node`` numbers the sets, and a component is named by one of its nodes.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), document_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    sets = materialize(base.mapInArrow(_set_batches(words), SET_DDL), "minhash-sets")
    nodes = sets.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("m"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select("s1", "s2", F.col("m.id").alias("id"), F.col("m.row").alias("row"), F.monotonically_increasing_id().alias("node"), "sig"), "minhash-nodes")

    def texts(needed: DataFrame, count: int) -> DataFrame:
        rows = materialize(nodes.select("row", "node").join(needed, "node"), "minhash-needed")
        return prefilter(base.select("row", "text"), rows, count, "row").dropDuplicates(["row"]).join(rows, "row").select("node", "text")

    signed = nodes.select("node", "sig")
    named = linked_classes(signature_members(signed, ROWS, BANDS), texts, lambda c: shingle_sets(c, words), percent=percent, block=BLOCK, what="minhash", nodes=signed, minima=BANDS * ROWS)
    classed = nodes.drop("sig").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return sets, materialize(classed.select("s1", "s2", "id", "row", "node", "component"), "minhash-classed")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents linked by ``100 * intersection >= percent * union`` of their word shingles.

    1. Equal sets are one node from here on (128-bit hash of the set).
    2. Nodes that share a band of minima are candidates; links are confirmed by
       signature and on the full sets of 64-bit shingle hashes
       (:func:`planforge.llm.banding.linked_classes`).
    3. Components by alternating large-star and small-star.

    Returns ``id_col, n_shingles, component_id, kept, row_key``: one row per input
    row; ``row_key`` is a 128-bit hash of id and text.
    ``component_id`` is the smallest id reachable; ``kept`` marks that document.
    Null and empty texts are linked with nothing and kept.  Rows that share an
    id each follow their own text.  A null id is never the smallest; if no
    document of a component has an id, its ``component_id`` is null and it is
    kept.  Further columns are not read.
    """
    sets, classed = _grouped(docs, id_col, text_col, words, percent)
    least = materialize(classed.groupBy("component").agg(F.min("id").alias("component_id")), "minhash-least")
    final = materialize(classed.join(least, "component").select("s1", "s2", F.lit(True).alias("found"), "component_id"), "minhash-final")
    out = sets.select("id", "n", "s1", "s2", "row").join(final, ["s1", "s2"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), F.col("row").alias("row_key"))


def surplus_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(row_key, chosen): what has to go for one row of each component of :func:`near_duplicates` to be left.

    Of a component the smallest (id is null, id, row key) is chosen.  Listed
    are the keys that are not, and with ``chosen`` those that are but belong to
    several rows (same id and text).  Rows without words are in no component.
    """
    sets, classed = _grouped(docs, id_col, text_col, words, percent)
    chosen = classed.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("m")).select(F.col("m.row").alias("row"), F.lit(True).alias("chosen"))
    rows = sets.where("n > 0").groupBy("row").agg(F.count(F.lit(1)).alias("copies")).join(materialize(chosen, "minhash-chosen"), "row", "left")
    return rows.where("chosen is null or copies > 1").select(F.col("row").alias("row_key"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2).drop("row_key")


#: The same result from all documents that share a shingle, without hashes.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[p : p + 1], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), least(len(words) + 1, 2)))) AS p FROM texts)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a AS doc_id, b AS other FROM ways
  UNION
  SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other
),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, other), doc_id) AS component_id, coalesce(least(doc_id, other), doc_id) = doc_id AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
