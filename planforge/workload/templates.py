"""Queries from templates: SQL with placeholders and generators that fill them from data."""

from __future__ import annotations

import random
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from planforge.plans.query import literal
from planforge.sources.storage import read_text

PLACEHOLDER = re.compile(r"<<([A-Za-z0-9_]+)>>")


class SamplingError(RuntimeError):
    """No value, or no new query, was found within the allowed tries."""


@dataclass
class Generator:
    """Fills its placeholders with one drawn candidate.

    ``kind`` sql: candidates are rows of a query, which may use placeholders of
    the generators it depends on; list: they are given.  ``weighted``: the last
    column is a weight.  ``operator`` IN draws ``least`` to ``most`` different
    candidates for a single placeholder.
    """

    name: str
    keys: tuple[str, ...]
    kind: str
    operator: str = "="
    columns: tuple[str, ...] = ()
    sql: str | None = None
    options: tuple = ()
    weighted: bool = False
    least: int = 1
    most: int = 1
    depends: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("sql", "list"):
            raise ValueError(f"{self.name}: type {self.kind} is neither sql nor list")
        if (self.kind == "sql") != (self.sql is not None):
            raise ValueError(f"{self.name}: sql goes with type sql and only with it")
        if self.operator.upper() == "IN" and len(self.keys) != 1:
            raise ValueError(f"{self.name}: IN fills one placeholder")
        if not 1 <= self.least <= self.most:
            raise ValueError(f"{self.name}: samples from {self.least} to {self.most}")

    def candidates(self, spark: SparkSession, filled: dict[str, str], cache: dict[str, list[tuple]]) -> list[tuple]:
        if self.kind == "list":
            return [tuple(o) if isinstance(o, (list, tuple)) else (o,) for o in self.options]
        sql = PLACEHOLDER.sub(lambda m: filled[m[1]], self.sql)
        if sql not in cache:
            cache[sql] = sorted((tuple(r) for r in spark.sql(sql).collect()), key=repr)  # the template's author bounds it
        return cache[sql]

    def draw(self, rng: random.Random, candidates: list[tuple]) -> dict[str, str]:
        values = [c[:-1] if self.weighted else c for c in candidates]
        weights = [float(c[-1]) for c in candidates] if self.weighted else [1.0] * len(candidates)
        if not values:
            raise SamplingError(f"{self.name} has no candidate")
        if self.operator.upper() == "IN":
            n = min(rng.randint(self.least, self.most), len(values))
            left, drawn = list(range(len(values))), []
            for _ in range(n):
                i = rng.choices(left, [weights[x] for x in left])[0]
                left.remove(i)
                drawn.append(values[i][0])
            return {self.keys[0]: "(" + ", ".join(map(literal, drawn)) + ")"}
        row = rng.choices(values, weights)[0]
        if len(row) != len(self.keys):
            raise ValueError(f"{self.name}: {len(row)} values for {len(self.keys)} placeholders")
        if self.operator.upper().endswith("LIKE"):
            return {k: literal(f"%{v}%") for k, v in zip(self.keys, row, strict=True)}
        return {k: literal(v) for k, v in zip(self.keys, row, strict=True)}


@dataclass
class Template:
    title: str
    sql: str
    generators: list[Generator]
    _cache: dict[str, list[tuple]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        named = {g.name: g for g in self.generators}
        self.order: list[Generator] = []

        def visit(g: Generator, above: tuple[str, ...]) -> None:
            if g.name in above:
                raise ValueError(f"{' -> '.join((*above, g.name))} depend on each other")
            if g in self.order:
                return
            for d in g.depends:
                visit(named[d], (*above, g.name))
            self.order.append(g)

        for g in self.generators:
            visit(g, ())
        missing = set(PLACEHOLDER.findall(self.sql)) - {k for g in self.generators for k in g.keys}
        if missing:
            raise ValueError(f"nothing fills {', '.join(sorted(missing))}")

    def draw(self, spark: SparkSession, rng: random.Random, tries: int = 100) -> str:
        """One query; if a draw leaves a later generator without candidates, all are drawn again."""
        for _ in range(tries):
            filled: dict[str, str] = {}
            try:
                for g in self.order:
                    filled |= g.draw(rng, g.candidates(spark, filled, self._cache))
            except SamplingError:
                continue
            return PLACEHOLDER.sub(lambda m: filled[m[1]], self.sql).strip()
        raise SamplingError(f"{self.title}: no query in {tries} tries")


def parse_template(text: str) -> Template:
    data = tomllib.loads(text)
    made = []
    for p in data.get("predicates", []):
        made.append(Generator(
            p["name"], tuple(p["keys"]), p["type"], p.get("pred_type", "="), tuple(p.get("columns", ())), p.get("sql"), tuple(p.get("options", ())),
            p.get("sampling_method", "uniform") == "weighted", p.get("min_samples", 1), p.get("max_samples", p.get("min_samples", 1)), tuple(p.get("dependencies", ())),
        ))
    return Template(data.get("title", ""), data["base_sql"]["sql"], made)


def load_template(spark: SparkSession, path: str) -> Template:
    return parse_template(read_text(spark, path))


def generate_workload(spark: SparkSession, templates: list[Template], per_template: int, *, seed: int = 0, tries: int = 100) -> dict[str, str]:
    """``per_template`` different queries of each template, labelled ``title-number``."""
    out: dict[str, str] = {}
    for t in templates:
        rng, seen, failed = random.Random(f"{seed}-{t.title}"), set(), 0
        while len(seen) < per_template:
            q = t.draw(spark, rng)
            if q in seen:
                failed += 1
                if failed >= tries:
                    raise SamplingError(f"{t.title}: {len(seen)} different queries of {per_template}")
                continue
            failed = 0
            seen.add(q)
            out[f"{t.title}-{len(seen)}"] = q
    return out
