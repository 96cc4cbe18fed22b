"""Command line: ``python -m planforge.workload.cli random|sample|templates``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from planforge.sources.registry import Database

from .executions import append_samples, load_workload, sample, store_workload
from .random_spj import distinct, generate
from .templates import generate_workload, load_template


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="planforge.workload")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("random", "sample"):
        p = sub.add_parser(name)
        p.add_argument("data", help="folder of the tables")
        p.add_argument("out", help="folder of .sql files, or Parquet table of samples")
        p.add_argument("-n", type=int, default=1000)
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--tables", type=int, nargs=2, default=(2, 5), metavar=("MIN", "MAX"))
        p.add_argument("--filters", type=int, nargs=2, default=(1, 5), metavar=("MIN", "MAX"))
        p.add_argument("--ignore", nargs="*", default=())
        p.add_argument("--like", help="folder of .sql files to resemble")
    p.add_argument("--workers", type=int, default=1)
    p.add_argument("--timeout", type=float)
    p.add_argument("--batches", type=int, default=1, help="how many times n queries are run and appended")
    p.add_argument("--keep-empty", action="store_true")
    p = sub.add_parser("templates")
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("templates", nargs="+")
    p.add_argument("-n", type=int, default=10)
    p.add_argument("--seed", type=int, default=0)
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    db = Database(spark, a.data)
    if a.command == "templates":
        for t in db.schema.tables:
            db.table(t).createOrReplaceTempView(t)
        store_workload(spark, a.out, generate_workload(spark, [load_template(spark, t) for t in a.templates], a.n, seed=a.seed))
        return 0
    like = None
    if a.like:
        from planforge.plans.parse import parse_query

        like = [parse_query(q) for q in load_workload(spark, a.like).values()]
    stream = generate(db, seed=a.seed, like=like, ignore=tuple(a.ignore), tables=tuple(a.tables), filters=tuple(a.filters))
    if a.command == "random":
        store_workload(spark, a.out, {f"q{i}": q for i, q in enumerate(distinct(stream, a.n))})
        return 0
    for _ in range(a.batches):
        append_samples(spark, sample(db, distinct(stream, a.n), workers=a.workers, timeout=a.timeout), a.out, keep_empty=a.keep_empty)
    return 0


if __name__ == "__main__":
    sys.exit(main())
