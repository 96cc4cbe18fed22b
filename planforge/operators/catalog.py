"""A catalog of degree-sequence bounds, plain and conditioned on filters.

For every (join column, filter column) one grouped job per kind of condition
yields all conditioned sequences at once; they are compressed in parallel and
kept as one table:

``tbl, join_col, kind, filter_col, level, key, lo, hi, slopes, widths``

kind ``all``: no condition; ``eq`` / ``eq_rest``: a common value / any other
value; ``range``: a histogram bucket; ``gram`` / ``gram_rest``: rows with a
common trigram / with any rare one.  Keys and edges are written as a letter
for the type and a canonical value, and a literal is brought into its column's
form before it is looked up: 10, 10.0 and a decimal 10.00 are one number, a date
and its midnight one time.
"""

from __future__ import annotations

import datetime
import json
import math
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.plans.query import And, Between, Compare, In, IsNull, Like, Or, Pred, QuerySpec, Ref
from planforge.sources.registry import Database
from planforge.sources.storage import materialize

from . import bound_tree
from .columns import mcv
from .degrees import degrees, valid_compress
from .histograms import bucket_edges, bucket_of
from .piecewise import Constant
from .trigrams import exploded, pattern_parts, pattern_trigrams

DDL = "tbl string, join_col string, kind string, filter_col string, level int, key string, lo string, hi string, slopes array<double>, widths array<double>"


@dataclass(frozen=True)
class Settings:
    accuracy: float = 0.01
    common: int = 1000
    depth: int = 7


@dataclass(frozen=True)
class Wanted:
    """(table, join column) pairs and, for each, the filter columns to condition on."""

    columns: tuple[tuple[str, str, tuple[str, ...]], ...]

    @classmethod
    def from_schema(cls, db: Database) -> Wanted:
        """Every declared join column, conditioned on every other column of its table."""
        joins = sorted({c for e in db.schema.edges() for c in e})
        return cls(tuple((t, c, tuple(f for f in db.table(t).columns if f != c and db.kind(t, f) != "other")) for t, c in joins))

    @classmethod
    def from_workload(cls, queries: list[QuerySpec]) -> Wanted:
        out: dict[tuple[str, str], set[str]] = {}
        for q in queries:
            for j in q.joins:
                for a, c in (j.left, j.right):
                    out.setdefault((q.tables[a], c), set()).update(r[1] for p in q.filters_of(a) for r in p.refs())
        return cls(tuple((t, c, tuple(sorted(f))) for (t, c), f in sorted(out.items())))


def kind_of(value) -> str:
    """The letter of a stored value: bool, exact number, floating number, day, time or string."""
    if isinstance(value, bool):
        return "b"
    if isinstance(value, (int, Decimal)):
        return "x"
    if isinstance(value, float):
        return "f"
    if isinstance(value, datetime.datetime):
        return "t"
    return "d" if isinstance(value, datetime.date) else "s"


def _time(value) -> datetime.datetime:
    if isinstance(value, str):
        value = datetime.datetime.fromisoformat(value.strip())
    if not isinstance(value, datetime.datetime):
        value = datetime.datetime.combine(value, datetime.time())
    return value.replace(tzinfo=None)


def comparable(kind: str, value):
    """A literal in the form in which values of a column of this kind compare; ValueError if it has none."""
    if kind == "b" and isinstance(value, bool):
        return value
    if kind in "xf" and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        if isinstance(value, float) and not math.isfinite(value):
            if math.isnan(value):
                raise ValueError(value)
            return value
        return Fraction(float(value)) if kind == "f" else Fraction(str(value))
    if kind in "dt" and isinstance(value, (str, datetime.date)):
        return _time(value)
    if kind == "s" and isinstance(value, str):
        return value
    raise ValueError(f"{value!r} does not compare as {kind}")


def encode(value) -> str:
    """The key of a stored value."""
    kind = kind_of(value)
    try:
        return f"{kind}:{comparable(kind, value)}"
    except ValueError:
        return f"{kind}:?{value}"  # no literal is equal to it


def decode(text: str | None):
    """The comparable value of a key; None for an open side."""
    if text is None or text == "null":
        return None
    kind, value = text.split(":", 1)
    if kind in "xf":
        return float(value) if value in ("inf", "-inf") else Fraction(value)
    return _time(value) if kind in "dt" else value == "True" if kind == "b" else value


def _compressed(degree_table: DataFrame, accuracy: float, by: tuple[str, ...], **fixed) -> DataFrame:
    """One catalog row per group of ``by``; the group's columns are named key, lo, hi or level."""
    segs = valid_compress(degree_table, accuracy, by)
    folded = segs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seg", "slope", "width"))).alias("s"))
    folded = folded.withColumn("slopes", F.col("s.slope")).withColumn("widths", F.col("s.width"))
    out = []
    for field in DDL.split(", "):
        name, kind = field.split(" ", 1)
        source = F.lit(fixed[name]) if name in fixed else F.col(name) if name in folded.columns else F.lit(None)
        out.append(source.cast(kind).alias(name))
    return folded.select(*out)


def _build_column(db: Database, table: str, join: str, filters: tuple[str, ...], settings: Settings) -> list[DataFrame]:
    df, acc = db.table(table), settings.accuracy
    spark, base = db.spark, {"tbl": table, "join_col": join}
    out = [_compressed(degrees(df, join).withColumn("key", F.lit(None).cast("string")), acc, ("key",), kind="all", filter_col=None, **base)]
    for f in filters:
        name = base | {"filter_col": f}
        top = [r[0] for r in mcv(df.where(F.col(f).isNotNull()), f, settings.common).select(f).collect()]
        keys = spark.createDataFrame([(v, encode(v)) for v in top], f"_v {dict(df.dtypes)[f]}, key string")
        tagged = df.where(F.col(join).isNotNull()).select(join, f).join(keys, F.col(f) == F.col("_v"), "left")
        counts = materialize(tagged.groupBy(join, "key", f).agg(F.count(F.lit(1)).alias("deg")), "catalog-degrees")
        out.append(_compressed(counts.where("key is not null").select(join, "key", "deg"), acc, ("key",), kind="eq", **name))
        rest = counts.where("key is null").groupBy(join).agg(F.sum("deg").alias("deg")).withColumn("key", F.lit(None).cast("string"))
        out.append(_compressed(rest, acc, ("key",), kind="eq_rest", **name))
        for level, edges in enumerate(bucket_edges(df, f, settings.depth)):
            bucket = counts.withColumn("_b", bucket_of(f, edges))
            inside = bucket.groupBy("_b", join).agg(F.sum("deg").alias("deg"))
            span = [("null" if i == 0 else encode(edges[i - 1]), "null" if i == len(edges) else encode(edges[i])) for i in range(len(edges) + 1)]
            spans = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(span)], "_b int, lo string, hi string")
            out.append(_compressed(inside.join(F.broadcast(spans), "_b").select(join, "lo", "hi", "deg"), acc, ("lo", "hi"), kind="range", level=level, **name))  # 2**depth rows at most
        if db.kind(table, f) == "text":
            texts = counts.where(F.col(f).isNotNull()).select(join, f, "deg")
            grams = exploded(texts.withColumn("_row", F.struct(join, f)), f, join, "_row", "deg").distinct()
            n = grams.groupBy("gram").agg(F.sum("deg").alias("n")).orderBy(F.desc("n"), "gram").limit(settings.common).select("gram").withColumn("common", F.lit(True))
            marked = materialize(grams.join(n, "gram", "left"), "catalog-grams")
            common = marked.where("common").groupBy("gram", join).agg(F.sum("deg").alias("deg")).select(join, F.to_json(F.struct("gram")).alias("key"), "deg")
            out.append(_compressed(common, acc, ("key",), kind="gram", **name))
            rare = marked.where("common is null").select(join, "_row", "deg").distinct().groupBy(join).agg(F.sum("deg").alias("deg")).withColumn("key", F.lit(None).cast("string"))
            out.append(_compressed(rare, acc, ("key",), kind="gram_rest", **name))
    return out


class Catalog:
    """Looks up bounds; the compressed functions of the wanted columns are held by the driver."""

    def __init__(self, rows, settings: Settings) -> None:
        self.settings = settings
        self.plain: dict[tuple[str, str], Constant] = {}
        self.eq: dict[tuple, dict[str, Constant]] = {}
        self.rest: dict[tuple, Constant] = {}
        self.ranges: dict[tuple, list[tuple[int, object, object, Constant]]] = {}
        self.kinds: dict[tuple, str] = {}  # of filter columns, as their stored values tell
        self.grams: dict[tuple, dict[str, Constant]] = {}
        self.rare: dict[tuple, Constant] = {}
        for r in rows:
            f, at = Constant.of_segments(r.slopes, r.widths), (r.tbl, r.join_col, r.filter_col)
            if r.kind == "all":
                self.plain[r.tbl, r.join_col] = f
            elif r.kind == "eq":
                self.eq.setdefault(at, {})[r.key] = f
                self.kinds[at] = r.key[0]
            elif r.kind == "eq_rest":
                self.rest[at] = f
            elif r.kind == "range":
                self.ranges.setdefault(at, []).append((r.level, decode(r.lo), decode(r.hi), f))
                for edge in (r.lo, r.hi):
                    if edge not in (None, "null"):
                        self.kinds[at] = edge[0]
            elif r.kind == "gram":
                self.grams.setdefault(at, {})[json.loads(r.key)["gram"]] = f
            elif r.kind == "gram_rest":
                self.rare[at] = f
        for v in self.ranges.values():
            v.sort(key=lambda x: -x[0])

    @classmethod
    def table(cls, db: Database, wanted: Wanted, settings: Settings = Settings()) -> DataFrame:
        frames = [f for t, c, filters in wanted.columns for f in _build_column(db, t, c, filters, settings)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    @classmethod
    def build(cls, db: Database, wanted: Wanted, settings: Settings = Settings(), path: str | None = None) -> Catalog:
        """Builds and, with a path, stores the catalog; without one it goes to the shared folder."""
        made = cls.table(db, wanted, settings)
        if path is None:
            return cls(materialize(made, "catalog").collect(), settings)
        made.withColumns({"accuracy": F.lit(settings.accuracy), "common": F.lit(settings.common), "depth": F.lit(settings.depth)}).write.mode("overwrite").parquet(path)
        return cls.load(db, path)

    @classmethod
    def load(cls, db: Database, path: str) -> Catalog:
        rows = db.spark.read.parquet(path).collect()
        return cls(rows, Settings(rows[0].accuracy, rows[0].common, rows[0].depth) if rows else Settings())

    def count(self) -> int:
        return len(self.plain) + len(self.rest) + len(self.rare) + sum(map(len, [*self.eq.values(), *self.ranges.values(), *self.grams.values()]))

    # --- lookups; each falls back on the unconditioned function ---

    def equal(self, table: str, join: str, column: str, value) -> Constant:
        """A literal that does not compare with the column in its own type says nothing: no condition then."""
        at = (table, join, column)
        if at not in self.rest and at not in self.eq:
            return self.plain[table, join]
        kind = self.kinds.get(at)
        if kind is None:  # no common value at all
            return self.rest.get(at, Constant.zero())
        try:
            key = f"{kind}:{comparable(kind, value)}"
        except ValueError:
            return self.plain[table, join]
        return self.eq.get(at, {}).get(key, self.rest.get(at, Constant.zero()))

    def between(self, table: str, join: str, column: str, lo, hi) -> Constant:
        """Deepest bucket that encloses [lo, hi]; None leaves a side open.  A bucket holds (its lo, its hi]."""
        at = (table, join, column)
        try:
            lo, hi = (None if v is None else comparable(self.kinds[at], v) for v in (lo, hi))
        except (KeyError, ValueError):
            return self.plain[table, join]
        for _, a, b, f in self.ranges.get(at, ()):
            if (a is None or (lo is not None and lo > a)) and (b is None or (hi is not None and hi <= b)):
                return f
        return self.plain[table, join]

    def like(self, table: str, join: str, column: str, pattern: str) -> Constant:
        at = (table, join, column)
        out = self.plain[table, join]
        if at in self.grams or at in self.rare:
            for gram in pattern_trigrams(pattern):
                out = out.lower(self.grams.get(at, {}).get(gram, self.rare.get(at, Constant.zero())))
        return out

    def conditioned(self, table: str, join: str, p: Pred) -> Constant:
        """Bound of the join column's degrees among the rows that satisfy a predicate."""
        plain = self.plain[table, join]
        match p:
            case Compare((_, c), "=", value):
                return self.equal(table, join, c, value)
            case Compare((_, c), "<" | "<=", value):
                return self.between(table, join, c, None, value)
            case Compare((_, c), ">" | ">=", value):
                return self.between(table, join, c, value, None)
            case Between((_, c), lo, hi):
                return self.between(table, join, c, lo, hi)
            case In((_, c), values):
                return self._sum([self.equal(table, join, c, v) for v in dict.fromkeys(values)], plain)
            case Like((_, c), pattern, False, False) if pattern_parts(pattern):
                return self.like(table, join, c, pattern)
            case And(parts):
                out = plain
                for x in parts:
                    out = out.lower(self.conditioned(table, join, x))
                return out
            case Or(parts):
                return self._sum([self.conditioned(table, join, x) for x in parts], plain)
            case IsNull():
                return plain
        return plain

    @staticmethod
    def _sum(parts: list[Constant], plain: Constant) -> Constant:
        out = Constant.zero()
        for f in parts:
            out = out + f
        return out.lower(plain)

    def functions(self, spec: QuerySpec) -> dict[Ref, Constant]:
        out = {}
        for c in spec.classes():
            for alias, column in c:
                table, f = spec.tables[alias], self.plain[spec.tables[alias], column]
                for p in spec.filters_of(alias):
                    f = f.lower(self.conditioned(table, column, p))
                out[alias, column] = f
        return out

    def estimate(self, spec: QuerySpec) -> float | None:
        """Upper bound of the query's size; unknown (None) without joins."""
        return bound_tree.bound(spec, self.functions(spec)) if spec.joins else None


def exact_functions(db: Database, spec: QuerySpec) -> dict[Ref, Constant]:
    """Uncompressed functions of a query's join columns after its filters, from the data."""
    from planforge.plans.query import to_column

    out = {}
    for c in spec.classes():
        for alias, column in c:
            df = db.table(spec.tables[alias])
            for p in spec.filters_of(alias):
                df = df.where(to_column(p))
            runs = degrees(df, column).groupBy("deg").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("deg")).collect()
            out[alias, column] = Constant([r.deg for r in runs], np.cumsum([r.m for r in runs]))
    return out
