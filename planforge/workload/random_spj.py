"""Random select-project-join queries over a schema, or like a given workload."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from planforge.plans.query import Compare, IsNull, Join, Like, Pred, QuerySpec, operators_used
from planforge.sources.registry import Database

RANGE = ("=", "<>", "<", "<=", ">", ">=")
POOL = 200  # default of Values: rows drawn per column


@dataclass
class Space:
    """What can be drawn: joins between tables, and operators by filter column."""

    joins: list[tuple[tuple[str, str], tuple[str, str]]]
    operators: dict[tuple[str, str], Counter] = field(default_factory=dict)

    @classmethod
    def of_schema(cls, db: Database, ignore: tuple[str, ...] = ()) -> Space:
        """All declared joins; every non-key column with every operator of its type."""
        joins = [e for e in db.schema.edges() if e[0][0] not in ignore and e[1][0] not in ignore]
        keys = {c for e in joins for c in e}
        ops: dict[tuple[str, str], Counter] = {}
        for t in sorted({c[0] for c in keys}):
            for column in db.table(t).columns:
                kind = db.kind(t, column)
                if (t, column) not in keys and not db.schema.is_key(t, column) and kind != "other":
                    ops[t, column] = Counter({o: 1 for o in (*RANGE, *(("LIKE", "NOT LIKE") if kind == "text" else ()))})
        return cls(joins, ops)

    @classmethod
    def of_workload(cls, queries: list[QuerySpec]) -> Space:
        """The joins and (column, operator) pairs that occur, as often as they occur."""
        joins, ops = set(), {}
        for q in queries:
            for j in q.joins:
                joins.add(tuple(sorted(((q.tables[j.left[0]], j.left[1]), (q.tables[j.right[0]], j.right[1])))))
            for (alias, column), op in operators_used(q.filters):
                ops.setdefault((q.tables[alias], column), Counter())[op] += 1
        return cls(sorted(joins), ops)

    def tables(self) -> list[str]:
        return sorted({c[0] for e in self.joins for c in e} | {c[0] for c in self.operators})


class Values:
    """Filter values per column: ``pool`` rows drawn by a hash of the row and the seed, so common values come more often.

    ``pool`` bounds what the driver holds of a column.  ``nulls`` is the share of rows without a value.
    """

    def __init__(self, db: Database, seed: int, pool: int = POOL) -> None:
        self.db, self.seed, self.size, self._pools = db, seed, pool, {}

    def draw(self, table: str, column: str) -> tuple[list, float]:
        """(values, share of nulls)."""
        if (table, column) not in self._pools:
            df = self.db.table(table)
            n, filled = df.agg(F.count(F.lit(1)), F.count(column)).first()
            rows = df.where(F.col(column).isNotNull()).select(F.xxhash64(F.lit(self.seed), *df.columns).alias("_h"), column)
            got = rows.orderBy("_h", column).limit(self.size).collect()
            self._pools[table, column] = [r[1] for r in got], (n - filled) / n if n else 0.0
        return self._pools[table, column]


def _value(v):
    return v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat() if isinstance(v, datetime.date) else v


def _predicate(rng: random.Random, values: Values, space: Space, alias: str, table: str, column: str) -> Pred:
    (pool, nulls), ops = values.draw(table, column), space.operators[table, column]
    ref = (alias, column)
    if not pool or rng.random() < nulls:  # a drawn row without a value
        return IsNull(ref, negated=bool(pool) and rng.random() < 0.5)
    op = rng.choices(sorted(ops), [ops[o] for o in sorted(ops)])[0]
    if op in ("IS", "IS NOT"):
        return IsNull(ref, negated=op == "IS NOT")
    v = rng.choice(pool)
    if op.endswith("LIKE"):
        text = str(v)
        words = [w for w in text.split() if w] or [text]
        return Like(ref, f"%{rng.choice(words)}%", negated=op.startswith("NOT"), ignore_case="ILIKE" in op)
    return Compare(ref, op, _value(v))


def generate(db: Database, *, seed: int = 0, like: list[QuerySpec] | None = None, ignore: tuple[str, ...] = (), tables: tuple[int, int] = (2, 5), filters: tuple[int, int] = (1, 5), counting: bool = True, pool: int = POOL) -> Iterator[QuerySpec]:
    """An endless stream of connected queries.

    Tables come from a random walk along joins (each table once), with one
    predicate for each joined pair among the chosen; filter columns are drawn
    without repetition, by how often the workload uses them.
    """
    rng, space = random.Random(seed), Space.of_workload(like) if like else Space.of_schema(db, ignore)
    values = Values(db, seed, pool)
    names = space.tables()
    if not names:
        raise ValueError("there is no table to draw from")
    while True:
        want = rng.randint(*tables)
        chosen = [rng.choice(names)]
        while len(chosen) < want:
            near = sorted({b[0] for a, b in space.joins if a[0] in chosen} | {a[0] for a, b in space.joins if b[0] in chosen})
            near = [t for t in near if t not in chosen]
            if not near:
                break
            chosen.append(rng.choice(near))
        if len(chosen) < tables[0]:
            continue
        joins, linked = [], set()
        for a, b in space.joins:
            if a[0] in chosen and b[0] in chosen and a[0] != b[0] and frozenset((a[0], b[0])) not in linked:
                linked.add(frozenset((a[0], b[0])))
                joins.append(Join(a, b))
        columns = [c for c in sorted(space.operators) if c[0] in chosen]
        drawn: list[Pred] = []
        for _ in range(min(rng.randint(*filters), len(columns))):
            c = rng.choices(columns, [sum(space.operators[x].values()) for x in columns])[0]
            columns.remove(c)
            drawn.append(_predicate(rng, values, space, c[0], *c))
        yield QuerySpec({t: t for t in chosen}, tuple(joins), tuple(drawn), None if counting else ())


def distinct(queries: Iterator[QuerySpec], n: int, *, tries: int = 1000) -> list[QuerySpec]:
    """The first ``n`` different queries; fewer if ``tries`` draws in a row bring nothing new."""
    out, seen, failed = [], set(), 0
    for q in queries:
        key = q.sql()
        if key in seen:
            failed += 1
            if failed >= tries:
                break
            continue
        failed = 0
        seen.add(key)
        out.append(q)
        if len(out) >= n:
            break
    return out
