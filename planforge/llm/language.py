"""Language identification: the family first, then pairwise linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize

#: Language families by ISO 639-1 code; other codes are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
DIMENSIONS = 2048
PER_LANGUAGE = 1000  # rows per language that the model is fitted on, if there are few languages
MOST_ROWS = 20000  # rows of all languages together; each language has one at least
PROFILED = 512  # rows of a dense matrix of profiles
FITTED = 64  # separating planes that are fitted at once
UNKNOWN = "und"
LETTER = np.isin(K.LOWER[np.arange(256)], np.arange(97, 123))


def profiles(c: K.Chunk) -> np.ndarray:
    """Square roots of the rates of hashed byte bigrams and trigrams (A-Z lower-cased) of each document."""
    data = K.LOWER[c.data].astype(np.int64)
    doc = np.repeat(np.arange(len(c)), c.ends - c.starts)
    out = np.zeros(len(c) * DIMENSIONS)
    for n in (2, 3):
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = data[:m] * 0x9E3779B1
        for i in range(1, n):
            h = (h + data[i : i + m]) * 0x85EBCA77
        key = doc[:m] * DIMENSIONS + ((h >> 16) % DIMENSIONS)
        whole = doc[:m] == doc[n - 1 :]
        out += np.bincount(key if whole.all() else key[whole], minlength=len(out))
    out = out.reshape(len(c), DIMENSIONS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def has_letter(c: K.Chunk) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(LETTER[c.data], dtype=np.int64)])
    got = total[c.ends] > total[c.starts]
    for d in np.flatnonzero(~got & (c.ends > c.starts)):
        got[d] = any(ch.isalpha() for ch in c.data[c.starts[d] : c.ends[d]].tobytes().decode("utf-8", "replace"))
    return got


def fit_svm(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear SVM (squared hinge, balanced classes, y = +-1) by accelerated gradient; the last weight is the bias.

    Each column of a two-dimensional ``y`` is a problem of its own and gives a row of weights.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(axis=0), 1), 0.5 / np.maximum((y < 0).sum(axis=0), 1)).astype(np.float32)
    w = np.zeros((x.shape[1], *y.shape[1:]), np.float32)
    ahead, rate = w, np.float32(1 / (2 * (2 + ridge)))  # rows have norm sqrt(2) with the bias
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = -2 * (x.T @ (weight * slack * y)) + 2 * ridge * ahead
        new = ahead - rate * grad
        ahead, w = new + (t / (t + 3)) * (new - w), new
    return w.T


@dataclass
class Hierarchy:
    """Weights of the family level (one against the rest) and of the pairs in each family."""

    families: list[str]
    members: dict[str, list[str]]
    top: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the score is the family's times the language's logistic margin."""
        margin = x @ self.top[:, :-1].T + self.top[:, -1]
        family = margin.argmax(axis=1)
        second = np.partition(margin, -2, axis=1)[:, -2] if margin.shape[1] > 1 else -margin[:, 0]
        score = 1 / (1 + np.exp(-2 * (margin.max(axis=1) - second)))
        lang = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            at, langs = np.flatnonzero(family == f), self.members[name]
            votes, sums = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                w = self.pairs[langs[i], langs[j]]
                m = x[at] @ w[:-1] + w[-1]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
            best = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1) if len(langs) > 1 else np.zeros(len(at), int)
            lang[at] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                score[at] *= 1 / (1 + np.exp(-2 * sums[np.arange(len(at)), best] / (len(langs) - 1)))
        return lang, score


def fit_hierarchy(x: np.ndarray, langs: np.ndarray) -> Hierarchy | None:
    if not len(langs):
        return None
    of = {code: name for name, codes in FAMILIES.items() for code in codes}
    family = np.array([of.get(v, v) for v in langs])
    names = sorted(set(family))
    members = {f: sorted(set(langs[family == f])) for f in names}
    top = np.concatenate([fit_svm(x, np.where(family[:, None] == np.array(names[i : i + FITTED]), 1, -1).astype(np.float32)) for i in range(0, len(names), FITTED)])
    out = Hierarchy(names, members, top)
    for f in names:
        for a, b in combinations(members[f], 2):
            at = (langs == a) | (langs == b)
            out.pairs[a, b] = fit_svm(x[at], np.where(langs[at] == a, 1, -1).astype(np.float32))
    return out


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(1), rows=PROFILED):
            x = profiles(c).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(c)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "profile"])


def train_language(rows: DataFrame, *, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Hierarchy | None:
    """Fits on (key, text, lang): about ``per_language`` rows of each language, chosen by a hash of the key.

    Every language is learned.  Where that would be more than ``most_rows`` in
    all, each language gets an equal part of ``most_rows``, and one row at least.
    """
    rows = rows.where("lang is not null and text is not null").select("text", "lang", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("place"))
    known = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")), "languages")
    languages = known.count()
    if not languages:
        return None
    each = max(1, min(per_language, most_rows // languages))
    shares = known.select("lang", "least", F.least(F.lit(1 << 30), F.floor(F.lit(each) / F.col("n") * (1 << 30))).alias("share"))
    # the model that is sent out has a row of weights per language: this table is smaller
    sample = rows.join(F.broadcast(shares.drop("least")), "lang").where("place < share").select("lang", "text")
    left_out = shares.where("least >= share").select("lang", F.col("least").alias("place"))
    if not left_out.isEmpty():
        sample = sample.union(rows.join(F.broadcast(left_out), ["lang", "place"]).groupBy("lang").agg(F.min("text").alias("text")))
    got = sample.select("lang", "text").mapInArrow(_profile_batches, "lang string, profile binary").toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    x = np.stack([np.frombuffer(b, np.float16) for b in got.column("profile").to_pylist()]).astype(np.float32)
    order = np.lexsort((x[:, 1], x[:, 0], langs.astype(str)))
    return fit_hierarchy(x[order], langs[order])


def predict_language(docs: DataFrame, model: Hierarchy | None, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), without_model: str = UNKNOWN) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score``: one row per input row, from the text alone.

    ``und`` with score 0 for null texts and texts without a letter.  Without a
    model the others get ``without_model`` with score 0.  Texts too short for a bigram get the model's bias.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(carry))]
    base = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), F.col(text_col).alias("text"))
    types = dict(base.dtypes)

    def predict(batches):
        for batch in batches:
            for c in K.chunks(batch.column(len(names)), rows=PROFILED):
                lang, score = np.full(len(c), UNKNOWN, dtype=object), np.zeros(len(c))
                ok = has_letter(c)
                if sent.value is None:
                    lang[ok] = without_model
                elif ok.any():
                    got, s = sent.value.predict(profiles(c))
                    lang[ok], score[ok] = got[ok], s[ok]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.first, len(c)) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    ddl = ", ".join([*(f"{n} {types[n]}" for n in names), "lang_pred string", "score double"])
    return base.mapInArrow(predict, ddl).withColumnsRenamed(dict(zip(names, carry, strict=True)))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> DataFrame:
    """Learns from the rows that are not held out and predicts all.

    Held out: crc32 of the id as text leaves 1 on division by 3 (a null id is
    not, but is not learned from either).  See :func:`train_language` and
    :func:`predict_language`.  Returns ``id_col, held_out, lang_pred, score``.
    Further columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train_language(rows, per_language=per_language, most_rows=most_rows)
    return predict_language(docs, model, text_col=text_col, carry=(id_col,)).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
