"""Running sampled queries and keeping what they returned and cost."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from planforge.operators.join_order import PreciseStats, build, optimize, result
from planforge.plans.parse import parse_query
from planforge.plans.query import QuerySpec
from planforge.plans.runtime import PlanNode, execute
from planforge.sources.registry import Database
from planforge.sources.storage import join_path, write_text

DDL = "query string, plan string, cardinality long, runtime_ms double"


@dataclass
class Sample:
    query: QuerySpec
    plan: PlanNode | None
    cardinality: int | None
    runtime_ms: float
    timed_out: bool = False


def plan_json(node: PlanNode) -> dict:
    return {"name": node.name, "rows": node.rows, "estimate": node.estimate, "children": [plan_json(c) for c in node.children]}


def plan_from_json(data: dict) -> PlanNode:
    return PlanNode(data["name"], "", [plan_from_json(c) for c in data["children"]], data["rows"], {}, data["estimate"])


def run_query(db: Database, q: QuerySpec, *, timeout: float | None = None, stats: PreciseStats | None = None) -> Sample:
    """Counts a query's rows in the bound-driven join order."""
    spec = q.counting()
    tree = optimize(spec, stats or PreciseStats(db), db.schema)
    done = execute(result(spec, build(spec, tree, db)), timeout=timeout)
    return Sample(q, done.plan, None if done.timed_out else int(done.rows[0][0]), done.seconds * 1000, done.timed_out)


def sample(db: Database, queries: list[QuerySpec], *, workers: int = 1, timeout: float | None = None) -> list[Sample]:
    """Runs queries, several at a time as jobs of one session; the order is kept."""
    stats = PreciseStats(db)
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda q: run_query(db, q, timeout=timeout, stats=stats), queries))


def samples_frame(spark: SparkSession, samples: list[Sample], *, keep_empty: bool = False) -> DataFrame:
    rows = [(s.query.sql(), json.dumps(plan_json(s.plan)) if s.plan else None, s.cardinality, s.runtime_ms) for s in samples if not s.timed_out and (keep_empty or s.cardinality)]
    return spark.createDataFrame(rows, DDL)


def append_samples(spark: SparkSession, samples: list[Sample], path: str, *, keep_empty: bool = False) -> None:
    """Appends to a Parquet table; queries without rows are left out unless asked for."""
    samples_frame(spark, samples, keep_empty=keep_empty).coalesce(1).write.mode("append").parquet(path)


def load_samples(source: DataFrame | str, spark: SparkSession | None = None, *, query_col: str = "query") -> list[tuple[QuerySpec, dict]]:
    """(parsed query, other columns) of a training set: a DataFrame, a Parquet path or a CSV path with header.

    Equal texts are parsed once.  Training sets fit the driver.
    """
    df = source
    if isinstance(source, str):
        df = spark.read.csv(source, header=True, inferSchema=True, escape='"', multiLine=True) if source.endswith(".csv") else spark.read.parquet(source)
    parsed: dict[str, QuerySpec] = {}
    out = []
    for r in df.collect():
        d = r.asDict()
        text = d.pop(query_col)
        if text not in parsed:
            parsed[text] = parse_query(text)
        out.append((parsed[text], d))
    return out


def store_workload(spark: SparkSession, path: str, workload: dict[str, QuerySpec | str]) -> None:
    """One ``label.sql`` file per query."""
    for label, q in workload.items():
        write_text(spark, join_path(path, f"{label}.sql"), (q if isinstance(q, str) else q.sql()).rstrip(";") + ";\n")


def load_workload(spark: SparkSession, path: str) -> dict[str, str]:
    from pyspark.sql import functions as F

    rows = spark.read.text(join_path(path, "*.sql"), wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sql$", 1).alias("label"), "value").collect()
    return {r.label: r.value.strip().rstrip(";") for r in sorted(rows)}
