"""Hint-set classification per query context."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planforge.functions import scalars as S
from planforge.operators.columns import like_card
from planforge.plans.query import Compare, In, Like, QuerySpec, simple_filters
from planforge.sources.registry import Database
from planforge.sources.storage import read_text, write_text

Context = frozenset  # of (table, column); (table, "") where columns do not matter

#: Three-bit codes of the comparison operators.
OPERATOR_BITS = {"=": (0, 0, 1), ">": (0, 1, 0), "<": (1, 0, 0), ">=": (0, 1, 1), "<=": (1, 0, 1), "<>": (1, 1, 0), "LIKE": (1, 1, 1), "ILIKE": (1, 1, 1), "IN": (0, 0, 1), "NOT LIKE": (1, 1, 0), "NOT ILIKE": (1, 1, 0)}
MOST_LABELS = 10_000  # default of Encodings.build: distinct text values that are numbered; columns with more are hashed


def context_of(q: QuerySpec, granularity: str = "table") -> Context:
    """What a query belongs to: all queries (schema), its tables, or its filtered columns."""
    if granularity == "schema":
        return frozenset()
    if granularity == "table":
        return frozenset((t, "") for t in q.tables.values())
    if granularity == "column":
        return frozenset((q.tables[r[0]], r[1]) for p in q.filters for r in p.refs())
    raise ValueError(granularity)


def super_contexts(contexts: list[Context]) -> dict[Context, Context]:
    """Each context with the smallest given context that holds it (itself if none is larger)."""
    return {c: covering(c, [d for d in contexts if c < d]) or c for c in contexts}


def covering(c: Context, contexts: list[Context]) -> Context | None:
    """The smallest of the contexts that holds ``c``; of equally large ones the first by name."""
    return min((d for d in contexts if c <= d), key=lambda d: (len(d), context_key(d)), default=None)


def merged(a: Context, b: Context) -> Context:
    return a | b


def without(a: Context, b: Context) -> Context:
    return a - b


def differing(a: Context, b: Context) -> Context:
    return a ^ b


def context_key(c: Context) -> str:
    """Stable over processes."""
    return hashlib.sha256(json.dumps(sorted(map(list, c))).encode()).hexdigest()[:16]


@dataclass
class Encodings:
    """Per column: extent of numbers and times, labels or hashing of text; selectivity of seen patterns."""

    extents: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    labels: dict[str, dict[str, float] | None] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)

    @classmethod
    def build(cls, db: Database, queries: list[QuerySpec], *, most_labels: int = MOST_LABELS) -> Encodings:
        """``most_labels`` bounds what the driver holds of a text column; None numbers every value."""
        out = cls()
        for q in queries:
            for p in simple_filters(q.filters):
                table, column = q.tables[p.ref[0]], p.ref[1]
                name, kind, df = f"{table}.{column}", db.kind(table, column), db.table(table)
                if kind in ("number", "time") and name not in out.extents:
                    value = F.col(column).cast("double") if kind == "number" else S.epoch(column).cast("double")
                    r = df.agg(F.min(value), F.max(value)).first()
                    out.extents[name] = (kind, r[0] or 0.0, r[1] or 0.0)
                if kind == "text" and not isinstance(p, Like) and name not in out.labels:
                    few = most_labels is None or df.select(column).distinct().limit(most_labels + 1).count() <= most_labels
                    out.labels[name] = {r[0]: r[1] for r in S.label_encode(df.where(F.col(column).isNotNull()), column).collect()} if few else None
                if isinstance(p, Like):
                    key = f"{name} {'ILIKE' if p.ignore_case else 'LIKE'} {p.pattern}"
                    if key not in out.patterns:
                        n = like_card(df, column, p.pattern, ignore_case=p.ignore_case).first()[0]
                        out.patterns[key] = round((n + 0.001) / (df.count() + 0.001), 4)
        return out

    def value(self, name: str, p) -> float:
        if isinstance(p, Like):
            share = self.patterns.get(f"{name} {'ILIKE' if p.ignore_case else 'LIKE'} {p.pattern}", 0.5)
            return 1 - share if p.negated else share
        values = p.values if isinstance(p, In) else (p.value,)
        return float(np.mean([self._one(name, v) for v in values]))

    def _one(self, name: str, v) -> float:
        if name in self.extents:
            kind, lo, hi = self.extents[name]
            if kind == "time":
                from planforge.functions.encoders import _seconds

                v = _seconds(v)
            offset = 0.001 if kind == "number" else 86400.0
            return round((float(v) + offset - lo) / (hi - lo + offset), 4)
        known = self.labels.get(name)
        if known is not None:
            return known.get(v, 0.0)
        number = int.from_bytes(hashlib.md5(str(v).encode()).digest()[:8], "little")
        return round((number + 1) / (2**64 + 1), 4)

    def to_json(self) -> str:
        return json.dumps({"extents": self.extents, "labels": self.labels, "patterns": self.patterns})

    @classmethod
    def from_json(cls, text: str) -> Encodings:
        d = json.loads(text)
        return cls({k: tuple(v) for k, v in d["extents"].items()}, d["labels"], d["patterns"])


def featurize(q: QuerySpec, columns: list[str], enc: Encodings) -> list[float]:
    """Four numbers per column: operator bits and value; zeros without a filter, the last filter counts."""
    out = {c: [0.0] * 4 for c in columns}
    for p in simple_filters(q.filters):
        name = f"{q.tables[p.ref[0]]}.{p.ref[1]}"
        if name not in out:
            continue
        op = p.op if isinstance(p, Compare) else "IN" if isinstance(p, In) else ("NOT " if p.negated else "") + ("ILIKE" if p.ignore_case else "LIKE")
        out[name] = [*map(float, OPERATOR_BITS[op]), enc.value(name, p)]
    return [x for c in columns for x in out[c]]


class ContextClassifier:
    """One classifier per context; a context with one label, or without filters, answers its most frequent label.

    Boosted trees, one model per label against the rest (Spark's are binary):
    the label with the highest probability is taken.  A query of an unseen
    context is answered by the smallest trained context that holds it, and if
    there is none by the most frequent label of the workload.
    """

    def __init__(self, spark: SparkSession, encodings: Encodings, *, granularity: str = "table") -> None:
        self.spark, self.encodings, self.granularity = spark, encodings, granularity
        self.columns: dict[str, list[str]] = {}
        self.labels: dict[str, list[int]] = {}  # most frequent first
        self.contexts: dict[str, Context] = {}
        self.models: dict[tuple[str, int], GBTClassificationModel] = {}
        self.default: int | None = None

    @staticmethod
    def _ranked(labels: list[int]) -> list[int]:
        n = Counter(labels)
        return sorted(n, key=lambda x: (-n[x], x))

    def fit(self, samples: list[tuple[QuerySpec, int]], *, trees: int = 20, depth: int = 4, seed: int = 0) -> None:
        groups: dict[Context, list[tuple[QuerySpec, int]]] = {}
        for q, label in samples:
            groups.setdefault(context_of(q, self.granularity), []).append((q, label))
        if samples:
            self.default = self._ranked([label for _, label in samples])[0]
        for context, members in groups.items():
            key = context_key(context)
            columns = sorted({f"{q.tables[p.ref[0]]}.{p.ref[1]}" for q, _ in members for p in simple_filters(q.filters)})
            known = self._ranked([label for _, label in members])
            self.contexts[key], self.columns[key], self.labels[key] = context, columns, known
            if len(known) > 1 and columns:
                for one in known if len(known) > 2 else known[:1]:
                    rows = [(Vectors.dense(featurize(q, columns, self.encodings)), float(label == one)) for q, label in members]
                    self.models[key, one] = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(self.spark.createDataFrame(rows, ["features", "label"]))

    def predict(self, q: QuerySpec) -> int:
        """Hint set of a query; ValueError only if nothing was ever fitted."""
        if self.default is None:
            raise ValueError("no sample was fitted")
        context = covering(context_of(q, self.granularity), list(self.contexts.values()))
        if context is None:
            return self.default
        key = context_key(context)
        known = self.labels[key]
        models = {one: self.models[key, one] for one in known if (key, one) in self.models}
        if not models:
            return known[0]
        x = Vectors.dense(featurize(q, self.columns[key], self.encodings))
        chance = {one: float(m.predictProbability(x)[1]) for one, m in models.items()}
        if len(known) == 2:
            return known[0] if chance[known[0]] >= 0.5 else known[1]
        return max(known, key=lambda one: chance[one])

    def store(self, path: str) -> None:
        for (key, one), m in self.models.items():
            m.write().overwrite().save(f"{path}/{key}-{one}")
        contexts = {k: sorted(map(list, c)) for k, c in self.contexts.items()}
        write_text(self.spark, f"{path}/manifest.json", json.dumps({"granularity": self.granularity, "columns": self.columns, "labels": self.labels, "contexts": contexts, "default": self.default, "models": sorted(map(list, self.models)), "encodings": self.encodings.to_json()}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ContextClassifier:
        d = json.loads(read_text(spark, f"{path}/manifest.json"))
        out = cls(spark, Encodings.from_json(d["encodings"]), granularity=d["granularity"])
        out.columns, out.labels, out.default = d["columns"], d["labels"], d["default"]
        out.contexts = {k: frozenset(map(tuple, c)) for k, c in d["contexts"].items()}
        out.models = {(k, one): GBTClassificationModel.load(f"{path}/{k}-{one}") for k, one in d["models"]}
        return out


def training_samples(labels: DataFrame, queries: dict[str, QuerySpec]) -> list[tuple[QuerySpec, int]]:
    """Pairs of a labelled workload; one row per query."""
    return [(queries[r.query_name], r.hint_set_int) for r in labels.collect() if r.query_name in queries]
