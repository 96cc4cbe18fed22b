"""Select-project-join queries as data: predicates, joins, rendering to SQL and DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ref = tuple[str, str]  # (alias, column)


@dataclass(frozen=True)
class Pred:
    """Base of all predicates."""

    def refs(self) -> tuple[Ref, ...]:
        return ()


@dataclass(frozen=True)
class Compare(Pred):
    ref: Ref
    op: str  # = <> < <= > >=
    value: object

    def refs(self):
        return (self.ref,)


@dataclass(frozen=True)
class Between(Pred):
    ref: Ref
    lo: object
    hi: object

    def refs(self):
        return (self.ref,)


@dataclass(frozen=True)
class In(Pred):
    ref: Ref
    values: tuple

    def refs(self):
        return (self.ref,)


@dataclass(frozen=True)
class Like(Pred):
    ref: Ref
    pattern: str
    negated: bool = False
    ignore_case: bool = False

    def refs(self):
        return (self.ref,)


@dataclass(frozen=True)
class IsNull(Pred):
    ref: Ref
    negated: bool = False

    def refs(self):
        return (self.ref,)


@dataclass(frozen=True)
class And(Pred):
    parts: tuple[Pred, ...]

    def refs(self):
        return tuple(r for p in self.parts for r in p.refs())


@dataclass(frozen=True)
class Or(Pred):
    parts: tuple[Pred, ...]

    def refs(self):
        return tuple(r for p in self.parts for r in p.refs())


@dataclass(frozen=True)
class Not(Pred):
    part: Pred

    def refs(self):
        return self.part.refs()


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def to_sql(p: Pred, name: Callable[[Ref], str] = lambda r: f"{r[0]}.{r[1]}") -> str:
    match p:
        case Compare(ref, op, value):
            return f"{name(ref)} {op} {literal(value)}"
        case Between(ref, lo, hi):
            return f"{name(ref)} BETWEEN {literal(lo)} AND {literal(hi)}"
        case In(ref, values):
            return f"{name(ref)} IN ({', '.join(map(literal, values))})"
        case Like(ref, pattern, negated, ignore_case):
            return f"{name(ref)} {'NOT ' if negated else ''}{'ILIKE' if ignore_case else 'LIKE'} {literal(pattern)}"
        case IsNull(ref, negated):
            return f"{name(ref)} IS {'NOT ' if negated else ''}NULL"
        case And(parts):
            return "(" + " AND ".join(to_sql(x, name) for x in parts) + ")"
        case Or(parts):
            return "(" + " OR ".join(to_sql(x, name) for x in parts) + ")"
        case Not(part):
            return f"NOT ({to_sql(part, name)})"
    raise TypeError(p)


def to_column(p: Pred, name: Callable[[Ref], str] = lambda r: r[1]) -> Column:
    match p:
        case Compare(ref, op, value):
            c = F.col(name(ref))
            return {"=": c == value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        case Between(ref, lo, hi):
            return F.col(name(ref)).between(lo, hi)
        case In(ref, values):
            return F.col(name(ref)).isin(*values)
        case Like(ref, pattern, negated, ignore_case):
            c = F.col(name(ref))
            hit = c.ilike(pattern) if ignore_case else c.like(pattern)
            return ~hit if negated else hit
        case IsNull(ref, negated):
            return F.col(name(ref)).isNotNull() if negated else F.col(name(ref)).isNull()
        case And(parts):
            out = to_column(parts[0], name)
            for x in parts[1:]:
                out = out & to_column(x, name)
            return out
        case Or(parts):
            out = to_column(parts[0], name)
            for x in parts[1:]:
                out = out | to_column(x, name)
            return out
        case Not(part):
            return ~to_column(part, name)
    raise TypeError(p)


def simple_filters(preds: Iterable[Pred]) -> list[Pred]:
    """Leaves that only conjunctions lead to; BETWEEN becomes its two sides."""
    out: list[Pred] = []
    for p in preds:
        match p:
            case And(parts):
                out += simple_filters(parts)
            case Between(ref, lo, hi):
                out += [Compare(ref, ">=", lo), Compare(ref, "<=", hi)]
            case Compare() | In() | Like():
                out.append(p)
    return out


def operators_used(preds: Iterable[Pred]) -> list[tuple[Ref, str]]:
    """(column, operator) of every leaf, through any nesting."""
    out: list[tuple[Ref, str]] = []
    for p in preds:
        match p:
            case And(parts) | Or(parts):
                out += operators_used(parts)
            case Not(part):
                out += operators_used([part])
            case Between(ref, _, _):
                out += [(ref, "<="), (ref, ">=")]
            case In(ref, _):
                out.append((ref, "="))
            case Compare(ref, op, _):
                out.append((ref, op))
            case Like(ref, _, negated, ignore_case):
                out.append((ref, ("NOT " if negated else "") + ("ILIKE" if ignore_case else "LIKE")))
            case IsNull(ref, negated):
                out.append((ref, "IS NOT" if negated else "IS"))
    return out


@dataclass(frozen=True)
class Join:
    left: Ref
    right: Ref

    def normal(self) -> tuple[Ref, Ref]:
        return tuple(sorted((self.left, self.right)))

    def sides(self, alias: str) -> tuple[Ref, Ref]:
        """(own, other) as seen from an alias."""
        return (self.left, self.right) if self.left[0] == alias else (self.right, self.left)


@dataclass(frozen=True)
class QuerySpec:
    """``tables``: alias to table in FROM order; ``filters``: predicates on one alias each; ``columns``: None counts rows."""

    tables: dict[str, str] = field(hash=False)
    joins: tuple[Join, ...] = ()
    filters: tuple[Pred, ...] = ()
    columns: tuple[Ref, ...] | None = None

    def __hash__(self) -> int:
        return hash((tuple(sorted(self.tables.items())), frozenset(j.normal() for j in self.joins), frozenset(self.filters), self.columns))

    def filters_of(self, alias: str) -> list[Pred]:
        return [p for p in self.filters if {r[0] for r in p.refs()} == {alias}]

    def fragment(self, aliases: Iterable[str]) -> QuerySpec:
        keep = set(aliases)
        return QuerySpec(
            {a: t for a, t in self.tables.items() if a in keep},
            tuple(j for j in self.joins if j.left[0] in keep and j.right[0] in keep),
            tuple(p for p in self.filters if {r[0] for r in p.refs()} <= keep),
            None if self.columns is None else tuple(c for c in self.columns if c[0] in keep),
        )

    def counting(self) -> QuerySpec:
        return replace(self, columns=None)

    def joins_of(self, alias: str) -> list[Join]:
        return [j for j in self.joins if alias in (j.left[0], j.right[0])]

    def classes(self) -> list[frozenset[Ref]]:
        """Equivalence classes of join columns."""
        groups: list[set[Ref]] = []
        for j in self.joins:
            hit = [g for g in groups if j.left in g or j.right in g]
            merged = {j.left, j.right}.union(*hit)
            groups = [g for g in groups if g not in hit] + [merged]
        return sorted((frozenset(g) for g in groups), key=sorted)

    def sql(self) -> str:
        what = "count(*) AS n" if self.columns is None else ", ".join(f"{a}.{c}" for a, c in self.columns) or "*"
        where = [f"{j.left[0]}.{j.left[1]} = {j.right[0]}.{j.right[1]}" for j in self.joins] + [to_sql(p) for p in self.filters]
        tables = ", ".join(t if a == t else f"{t} {a}" for a, t in self.tables.items())
        return f"SELECT {what} FROM {tables}" + (" WHERE " + " AND ".join(where) if where else "")

    def needed(self, alias: str, every: Iterable[str]) -> list[str]:
        """Columns of an alias that joins, filters or the result need; all of ``every`` for SELECT *."""
        if self.columns == ():
            return list(every)
        use = [r for j in self.joins for r in (j.left, j.right)] + [r for p in self.filters for r in p.refs()] + list(self.columns or ())
        return [c for c in every if (alias, c) in use]


def qualified(ref: Ref) -> str:
    return f"{ref[0]}__{ref[1]}"


def scan(spec: QuerySpec, alias: str, table: DataFrame) -> DataFrame:
    """An alias's rows after its filters, with columns named ``alias__column``."""
    df = table
    for p in spec.filters_of(alias):
        df = df.where(to_column(p))
    names = spec.needed(alias, table.columns)
    return df.select(*(F.col(c).alias(qualified((alias, c))) for c in names)) if names else df.select(F.lit(1).alias(f"{alias}__"))
