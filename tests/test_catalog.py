"""Catalog bounds hold for literals of every type, and the synopsis explores by running plans."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from planforge.operators.catalog import Catalog, Settings, Wanted, comparable, encode
from planforge.operators.join_order import PreciseStats, optimize
from planforge.operators.synopsis import Synopsis
from planforge.plans.parse import parse_query
from planforge.plans.query import Compare, In, Join, QuerySpec
from planforge.sources.registry import Database, Schema, TableSpec


def test_keys_are_canonical():
    assert encode(10) == "x:10" and encode(Decimal("10.00")) == "x:10" and encode(10.0) == "f:10" and encode("a:b") == "s:a:b"
    assert comparable("x", 10.0) == comparable("x", 10) == comparable("x", Decimal("10.0")) and comparable("f", 10) == comparable("f", 10.0)
    day = datetime.date(2020, 1, 2)
    assert comparable("d", "2020-01-02") == comparable("t", day) == comparable("t", "2020-01-02 00:00:00")
    for kind, value in (("x", "10"), ("s", 10), ("t", "no time"), ("f", True), ("b", 1), ("f", float("nan"))):
        with pytest.raises(ValueError):
            comparable(kind, value)


def test_bounds_hold_for_literals_of_every_type(spark, tmp_path):
    rng = random.Random(3)
    day = datetime.date(2020, 1, 1)
    draw = lambda v: None if rng.random() < 0.1 else v
    rows = [(rng.randrange(20), draw(i % 7), draw(float(i % 5) / 4), draw(Decimal(i % 6) / 2), draw(day + datetime.timedelta(i % 9)), draw(datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=12 * (i % 11))), draw(f"name{i % 8}"), draw(i % 3 == 0)) for i in range(400)]
    spark.createDataFrame(rows, "k int, i int, f double, x decimal(10,2), d date, t timestamp, s string, b boolean").write.parquet(str(tmp_path / "fact.parquet"))
    spark.createDataFrame([(k % 20, k) for k in range(40)], "k int, z int").write.parquet(str(tmp_path / "dim.parquet"))
    db = Database(spark, str(tmp_path), Schema({"dim": TableSpec("dim"), "fact": TableSpec("fact", (), {"k": ("dim", "k")})}))
    for common in (3, 1000):
        catalog = Catalog.build(db, Wanted((("fact", "k", ("i", "f", "x", "d", "t", "s")), ("dim", "k", ()))), Settings(common=common, depth=3))
        literals = {
            "i": [0, 3, 3.0, Decimal(3), 99], "f": [0, 0.25, 1, 1.0, Decimal("0.5"), 7.5], "x": [1, 1.5, Decimal("2.50"), 0.5, 33],
            "d": [day, "2020-01-03", "2021-01-01", datetime.date(2020, 1, 9)], "t": ["2020-01-02", "2020-01-02 12:00:00", datetime.datetime(2020, 1, 3), day], "s": ["name3", "name9", ""],
        }
        fact, seen, checks = db.table("fact"), 0, []
        for column, values in literals.items():
            c = F.col(column)
            for v in values:
                hits = {"=": c == F.lit(v), "<": c < F.lit(v), "<=": c <= F.lit(v), ">": c > F.lit(v), ">=": c >= F.lit(v)}
                checks += [(Compare(("f", column), op, v), hit) for op, hit in hits.items()]
            checks.append((In(("f", column), tuple(values)), c.isin(values)))
        counts = fact.agg(*(F.count(F.when(hit, 1)).alias(f"n{i}") for i, (_, hit) in enumerate(checks))).first()
        for (predicate, _), n in zip(checks, counts, strict=True):
            bound = catalog.estimate(QuerySpec({"f": "fact", "d": "dim"}, (Join(("f", "k"), ("d", "k")),), (predicate,), None))
            assert bound >= 2 * n - 1e-6, (predicate, bound, n)  # each k is in dim twice
            seen += n > 0
        assert seen > 15


def test_synopsis_explores_and_learns_from_runs(spark, data):
    db = Database(spark, data)
    spec = parse_query("SELECT count(*) FROM region r, nation n, supplier s WHERE n.n_regionkey = r.r_regionkey AND s.s_nationkey = n.n_nationkey")
    tree = optimize(spec, PreciseStats(db), db.schema)
    synopsis = Synopsis()
    assert synopsis.explore_executed(db, spec, tree, ("hash", "merge"), most=3) == 3
    known = synopsis.recommend(spec, tree)
    assert synopsis.rows() and all(c > 0 for *_, c in synopsis.rows())
    assert set(synopsis.feedback(db, spec, tree)) == set(known)
    synopsis.reset()
    assert not synopsis.rows() and not synopsis.feedback(db, spec, tree)
