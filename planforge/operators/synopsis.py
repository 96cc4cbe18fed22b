"""Experience with join operators, kept by join path, and their recommendation."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planforge.plans.query import QuerySpec, to_sql
from planforge.plans.runtime import execute
from planforge.sources.registry import Database
from planforge.sources.storage import materialize

from .join_order import JOIN_HINTS, Tree, build

Step = tuple[tuple[str, ...], tuple[str, ...]]  # tables and, if the synopsis looks at them, filters
GAMMA = 0.8


def cost_fold(observations: DataFrame, group: str, order: str, cost: str, *, gamma: float = GAMMA) -> DataFrame:
    """(group, cost): sum of all costs, each older one damped by another ``gamma``.

    ``order`` is unique within a group.  Observations are range-partitioned by
    (group, order), so a hot group is spread; each partition folds its own part
    of a group, and the parts, one row per group and partition, are folded in
    order: an older part is damped once for every later observation.
    """
    parts = materialize(observations.select(group, order, cost).repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()), "fold-parts")
    own = Window.partitionBy(group, "_part").orderBy(F.desc(order))
    folded = parts.withColumn("_r", F.row_number().over(own)).groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(cost) * F.pow(F.lit(gamma), F.col("_r") - 1)).alias("_cost"))
    later = Window.partitionBy(group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    damped = folded.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    return damped.groupBy(group).agg(F.sum(F.col("_cost") * F.pow(F.lit(gamma), F.col("_later"))).alias("cost"))


def join_path(spec: QuerySpec, tree: Tree, filters: bool = False) -> list[tuple[Step, Tree]]:
    """Steps from the deepest join to the top, with the join that each makes.

    A step names the tables that the join adds: the first one both of its
    sides.  A subtree on the other side is a step of several tables.
    """

    def step(aliases: frozenset[str]) -> Step:
        tables = tuple(sorted(spec.tables[a] for a in aliases))
        if not filters:
            return tables, ()
        names = {a: spec.tables[a] for a in aliases}
        return tables, tuple(sorted(to_sql(p, lambda r: f"{names[r[0]]}.{r[1]}") for a in aliases for p in spec.filters_of(a)))

    out: list[tuple[Step, Tree]] = []
    node = tree
    while not node.alias:
        deep, side = (node.left, node.right) if len(node.left.inner_nodes()) >= len(node.right.inner_nodes()) else (node.right, node.left)
        out.append((step(side.aliases if not deep.alias else node.aliases), node))
        node = deep
    return out[::-1]


@dataclass
class Node:
    costs: dict[str, float] = field(default_factory=dict)
    children: dict[Step, Node] = field(default_factory=dict)


class Synopsis:
    """A tree of join steps; each node keeps a damped cost for each operator seen there."""

    def __init__(self, *, gamma: float = GAMMA, filters: bool = False) -> None:
        self.gamma, self.filters, self.root = gamma, filters, Node()

    def _walk(self, spec: QuerySpec, tree: Tree, grow: bool):
        node = self.root
        for step, join in join_path(spec, tree, self.filters):
            if node is not None and step not in node.children and grow:
                node.children[step] = Node()
            node = node.children.get(step) if node is not None else None
            yield join, node
        for join in tree.inner_nodes():  # subtrees have paths of their own
            for side in (join.left, join.right):
                on_path = any(j is side for _, j in join_path(spec, tree, self.filters))
                if not side.alias and not on_path:
                    yield from self._walk(spec, side, grow)

    def integrate(self, spec: QuerySpec, tree: Tree, operators: dict[frozenset[str], str], costs: dict[frozenset[str], float]) -> None:
        """Adds one execution: the operator and cost of each join, by the aliases it covers."""
        for join, node in self._walk(spec, tree, True):
            if join.aliases in operators and join.aliases in costs:
                op = operators[join.aliases]
                node.costs[op] = costs[join.aliases] + self.gamma * node.costs.get(op, 0.0)

    def recommend(self, spec: QuerySpec, tree: Tree) -> dict[frozenset[str], str]:
        """Cheapest operator of each join with at least two known ones."""
        return {join.aliases: min(node.costs, key=lambda o: (node.costs[o], o)) for join, node in self._walk(spec, tree, False) if node is not None and len(node.costs) >= 2}

    def unknown(self, spec: QuerySpec, tree: Tree, operators: tuple[str, ...]) -> dict[frozenset[str], list[str]]:
        """Operators without a cost at each join of the tree."""
        out = {}
        for join, node in self._walk(spec, tree, False):
            missing = [o for o in operators if node is None or o not in node.costs]
            if missing:
                out[join.aliases] = missing
        return out

    def explore(self, spec: QuerySpec, tree: Tree, operators: tuple[str, ...], cost_of: Callable[[dict[frozenset[str], str]], dict[frozenset[str], float]], *, most: int | None = None, seed: int = 0) -> int:
        """Costs combinations of operators (all, or ``most`` drawn at random) and integrates them; returns how many."""
        joins = [j.aliases for j in tree.inner_nodes()]
        total = len(operators) ** len(joins)
        if most is None or total <= most:
            combos = [dict(zip(joins, c, strict=True)) for c in product(operators, repeat=len(joins))]
        else:
            rng, seen = random.Random(seed), set()
            while len(seen) < most:
                seen.add(tuple(rng.choice(operators) for _ in joins))
            combos = [dict(zip(joins, c, strict=True)) for c in sorted(seen)]
        for combo in combos:
            self.integrate(spec, tree, combo, cost_of(combo))
        return len(combos)

    def explore_executed(self, db: Database, spec: QuerySpec, tree: Tree, operators: tuple[str, ...] = tuple(JOIN_HINTS), *, timeout: float | None = None, most: int | None = None, seed: int = 0) -> int:
        """As explore, with true costs: each hinted plan runs, and a join costs the seconds of its subtree under the combination.

        A run that exceeds ``timeout`` counts with it.
        """

        def measure(combo: dict[frozenset[str], str]) -> dict[frozenset[str], float]:
            out = {}
            for join in tree.inner_nodes():
                chosen = {a: op for a, op in combo.items() if a <= join.aliases}
                out[join.aliases] = execute(build(spec, join, db, operators=chosen), timeout=timeout, rows=False).seconds
            return out

        return self.explore(spec, tree, operators, measure, most=most, seed=seed)

    def feedback(self, db: Database, spec: QuerySpec, tree: Tree, *, timeout: float | None = None) -> dict[frozenset[str], float]:
        """Runs the tree as recommended and integrates what its joins cost; joins without a recommendation run as Spark plans them and are not learned from."""
        chosen = self.recommend(spec, tree)
        costs = {}
        for join in tree.inner_nodes():
            if join.aliases in chosen:
                inside = {a: op for a, op in chosen.items() if a <= join.aliases}
                costs[join.aliases] = execute(build(spec, join, db, operators=inside), timeout=timeout, rows=False).seconds
        self.integrate(spec, tree, chosen, costs)
        return costs

    def reset(self) -> None:
        """Forgets all experience."""
        self.root = Node()

    def rows(self) -> list[tuple]:
        out: list[tuple] = []

        def walk(node: Node, path: list[Step]) -> None:
            for op, cost in sorted(node.costs.items()):
                out.append(([list(t) for t, _ in path], [list(f) for _, f in path], op, float(cost)))
            for step, child in sorted(node.children.items()):
                walk(child, [*path, step])

        walk(self.root, [])
        return out

    DDL = "tables array<array<string>>, filters array<array<string>>, operator string, cost double"

    def store(self, spark: SparkSession, path: str) -> None:
        df = spark.createDataFrame(self.rows(), self.DDL).withColumn("gamma", F.lit(self.gamma)).withColumn("filter_aware", F.lit(self.filters))
        df.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Synopsis:
        """A synopsis has one row per join path and operator that a workload met; it lives on the driver."""
        rows = spark.read.parquet(path).collect()
        out = cls(gamma=rows[0].gamma, filters=rows[0].filter_aware) if rows else cls()
        for r in rows:
            node = out.root
            for t, f in zip(r.tables, r.filters, strict=True):
                node = node.children.setdefault((tuple(t), tuple(f)), Node())
            node.costs[r.operator] = r.cost
        return out

    def describe(self) -> str:
        lines: list[str] = []

        def walk(node: Node, depth: int) -> None:
            for (tables, filters), child in sorted(node.children.items()):
                costs = ", ".join(f"{o}={c:.4g}" for o, c in sorted(child.costs.items()))
                lines.append("  " * depth + " ".join(tables) + (f" [{' and '.join(filters)}]" if filters else "") + (f": {costs}" if costs else ""))
                walk(child, depth + 1)

        walk(self.root, 0)
        return "\n".join(lines)
