"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_punct", "longest_word")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8))
CONTINUES = np.arange(256) & 0xC0 == 0x80
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SAMPLE = 20_000  # labelled rows that the model is fitted on
MAX_LOSS = 0.01  # share of good labelled rows that the threshold may reject

#: Features of the model and the sign that quality must follow (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "distinct_rate": 0, "digit_rate": 0, "upper_rate": 0, "punct_rate": 0, "longest_word": 0, "words_per_line": 0}


def _per_doc(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal in its document, has an equal before it in its document)."""
    key = hashes + K.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    any_, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    later[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    any_[order] = either
    return any_, later


def statistics(c: K.Chunk) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each document of a chunk."""
    data, w = c.data, K.words(c)
    prefix = K.byte_prefix(data)
    tokens, doc = K.range_hash(prefix, w.starts, w.ends), w.doc
    points = np.concatenate([[0], np.cumsum(~CONTINUES[data], dtype=np.int64)])
    width = points[w.ends] - points[w.starts]
    out = {"n_words": w.counts, "word_chars": np.bincount(doc, weights=width, minlength=len(c)).astype(np.int64)}
    out["n_symbols"] = _per_doc(SYMBOLS[data], c.starts, c.ends)
    # lines: between newlines and document borders
    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([c.starts, newline + 1]), kind="stable")
    line_doc = np.searchsorted(c.starts, line_start, side="right") - 1
    # a document's last newline at its end opens an empty line of its own: borders that coincide are empty documents or lines
    border = np.concatenate([newline, c.ends])
    line_end = np.sort(border, kind="stable")
    ok = line_end > line_start
    line_start, line_end, line_doc = line_start[ok], line_end[ok], line_doc[ok]
    filled = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, line_start)
    line_start, line_end, line_doc = line_start[filled], line_end[filled], line_doc[filled]
    _, later = _repeated(line_doc, K.range_hash(prefix, line_start, line_end))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=len(c))
    n = len(tokens) - REPEAT_WINDOW + 1
    covered = np.zeros(len(tokens), bool)
    if n > 0:
        at = np.flatnonzero(doc[:n] == doc[REPEAT_WINDOW - 1 :])
        any_, _ = _repeated(doc[at], K.range_hash(K.token_prefix(tokens), at, at + REPEAT_WINDOW))
        covered = K.set_bits(len(tokens), at[any_], at[any_] + REPEAT_WINDOW)
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(c))
    out["n_chars"] = points[c.ends] - points[c.starts]
    out["n_lines"] = np.bincount(line_doc, minlength=len(c))
    _, again = _repeated(doc, tokens)
    out["n_distinct_words"] = np.bincount(doc[~again], minlength=len(c))
    for name, table in (("n_digits", DIGITS), ("n_upper", UPPER), ("n_punct", PUNCT)):
        out[name] = _per_doc(table[data], c.starts, c.ends)
    longest = np.zeros(len(c), np.int64)
    np.maximum.at(longest, doc, width)
    out["longest_word"] = longest
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1).astype(float), np.maximum(s["n_chars"], 1).astype(float)
    lines = np.maximum(s["n_lines"], 1).astype(float)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_distinct_words"] / words, s["n_digits"] / chars, s["n_upper"] / chars, s["n_punct"] / chars, s["longest_word"].astype(float), words / lines], axis=1)


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees of the logistic loss with second-order leaves on quantile histograms.

    A split on a feature with a sign must give children in that order, and the
    middle of the two bounds all that is below them, so the sum is monotonic.
    """
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)

        def leaf(rows, lo, hi, grad=grad, hess=hess):
            return float(np.clip(rate * grad[rows].sum() / (hess[rows].sum() + ridge), lo, hi))

        def grow(rows, level, lo, hi, grad=grad, hess=hess, leaf=leaf):
            me = len(nodes)
            nodes.append([0, 0.0, me, me, leaf(rows, lo, hi)])
            if level == depth or len(rows) < 2 * least:
                raw[rows] += nodes[me][4]
                return me
            g, h, best = grad[rows], hess[rows], (1e-6, -1, -1)
            total = g.sum() ** 2 / (h.sum() + ridge)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = code[rows, j]
                n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                gl, hl = np.cumsum(np.bincount(k, g, len(c) + 1))[:-1], np.cumsum(np.bincount(k, h, len(c) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total
                ok = (n >= least) & (len(rows) - n >= least)
                if signs[j]:
                    ok &= signs[j] * (gr / (hr + ridge) - gl / (hl + ridge)) >= 0
                gain = np.where(ok, gain, -1)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, b)
            if best[1] < 0:
                raw[rows] += nodes[me][4]
                return me
            _, j, b = best
            goes = code[rows, j] <= b
            a, z = rows[goes], rows[~goes]
            la = lz = (lo, hi)
            if signs[j]:
                middle = (leaf(a, lo, hi) + leaf(z, lo, hi)) / 2
                la, lz = ((lo, middle), (middle, hi)) if signs[j] > 0 else ((middle, hi), (lo, middle))
            nodes[me][:2] = [j, float(cuts[j][b])]
            nodes[me][2] = grow(a, level + 1, *la)
            nodes[me][3] = grow(z, level + 1, *lz)
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    f = list(zip(*nodes, strict=True))
    return Trees(np.array(f[0], int), np.array(f[1]), np.array(f[2], int), np.array(f[3], int), np.array(f[4]), np.array(roots), depth, base)


STATS_DDL = "id long, " + ", ".join(f"{n} long" for n in COUNTS + MORE)


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(1)):
            s = statistics(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)), *(pa.array(s[n], pa.int64()) for n in COUNTS + MORE)], names=["id", *COUNTS, *MORE])


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_stat_batches, STATS_DDL)


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int) -> Trees | None:
    """Fits on at most about ``sample`` labelled rows, chosen by a hash of the id; None without both classes.

    The threshold rejects at most ``MAX_LOSS`` of the good rows of the sample.
    """
    labels = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    got = stats.join(labels, "id").toArrow()
    y = got.column("good").to_numpy().astype(float)
    if len(y) < 50 or y.min() == y.max():
        return None
    order = np.lexsort([got.column(n).to_numpy() for n in ("n_chars", "n_words", "id")])
    x = features({n: got.column(n).to_numpy() for n in COUNTS + MORE})[order]
    model = fit_trees(x, y[order], list(FEATURES.values()))
    model.threshold = min(0.5, float(np.quantile(model.score(x)[y[order] == 1], MAX_LOSS)))
    return model


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Statistics, score and verdict of every document.

    ``labels`` (id long, good int 0/1): rows to fit on; repeated ids count once
    (the worst label), null ids or labels not at all.  Quality may only fall
    with the rates of symbols, repeated lines and repeated words.  The base
    rules fail a document with under 10 words or over 20% repeated words.

    Returns ``id_col``, the statistics, ``score`` (null without a model),
    ``base_failed`` and ``kept``: one row per input row.  Null and empty texts
    have no words and fail; without labels of both classes the base rules alone
    decide.  Further columns are not read.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit_quality(stats, labels, sample)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if model is None:
        return stats.withColumns({"score": F.lit(None).cast("double"), "base_failed": failed, "kept": ~failed}).withColumnRenamed("id", id_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            s = {n: batch.column(n).to_numpy() for n in COUNTS + MORE}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(features(s)))], names=[*batch.schema.names, "score"])

    scored = stats.mapInArrow(score, STATS_DDL + ", score double")
    return scored.withColumns({"base_failed": failed, "kept": ~failed & (F.col("score") >= model.threshold)}).withColumnRenamed("id", id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge_quality(docs, labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("good")))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
