import random

import pytest

from planforge.plans.parse import parse_query
from planforge.sources.registry import Database
from planforge.sources.storage import load_or_build, read_text, write_text
from planforge.workload.cli import main
from planforge.workload.executions import append_samples, load_samples, load_workload, sample
from planforge.workload.random_spj import Space, distinct, generate
from planforge.workload.templates import SamplingError, generate_workload, parse_template

TEMPLATE = """
title = "seg"
[base_sql]
sql = "SELECT count(*) AS n FROM customer c, orders o WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment IN <<seg>> AND o.o_orderstatus = <<status>> AND c.c_nationkey = <<nation>>"
[[predicates]]
name = "nation"
keys = ["nation"]
type = "sql"
columns = ["c.c_nationkey"]
sql = "SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment IN <<seg>>"
dependencies = ["segment"]
[[predicates]]
name = "segment"
keys = ["seg"]
type = "sql"
pred_type = "IN"
sampling_method = "weighted"
columns = ["c.c_mktsegment"]
sql = "SELECT c_mktsegment, count(*) FROM customer GROUP BY 1"
min_samples = 1
max_samples = 3
[[predicates]]
name = "status"
keys = ["status"]
type = "list"
options = ["F", "O"]
"""


@pytest.fixture(scope="module")
def db(spark, data):
    out = Database(spark, data)
    for t in out.schema.tables:
        out.table(t).createOrReplaceTempView(t)
    return out


def test_random_queries_are_connected_seeded_and_run(db):
    a, b = (distinct(generate(db, seed=3, tables=(2, 4)), 8) for _ in range(2))
    assert [q.sql() for q in a] == [q.sql() for q in b] and len({q.sql() for q in a}) == 8
    assert [q.sql() for q in distinct(generate(db, seed=4, tables=(2, 4)), 8)] != [q.sql() for q in a]
    for q in a:
        assert len(q.joins) >= len(q.tables) - 1 and parse_query(q.sql()) == q
        db.spark.sql(q.sql()).collect()


def test_like_a_workload(db):
    like = [parse_query("SELECT count(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'")]
    assert set(Space.of_workload(like).operators) == {("orders", "o_orderstatus")}
    for q in distinct(generate(db, like=like, tables=(2, 2), filters=(1, 1)), 3):
        assert set(q.tables.values()) == {"orders", "customer"} and [p.op for p in q.filters] == ["="]


def test_templates(db):
    t = parse_template(TEMPLATE)
    assert [g.name for g in t.order] == ["segment", "nation", "status"]
    a, b = (generate_workload(db.spark, [t], 5, seed=1) for _ in range(2))
    assert a == b and len(set(a.values())) == 5 and "seg-1" in a
    for q in a.values():
        assert db.spark.sql(q).first()[0] is not None
    few = parse_template('title="x"\n[base_sql]\nsql="SELECT 1 AS n WHERE 1 = <<a>>"\n[[predicates]]\nname="a"\nkeys=["a"]\ntype="list"\noptions=[1]\n')
    with pytest.raises(SamplingError):
        generate_workload(db.spark, [few], 2, tries=3)
    for bad in (TEMPLATE.replace('keys = ["status"]', 'keys = ["other"]'), TEMPLATE.replace('name = "segment"', 'name = "segment"\ndependencies = ["nation"]'), TEMPLATE.replace('type = "list"', 'type = "guess"'), TEMPLATE.replace("min_samples = 1", "min_samples = 9")):
        with pytest.raises(ValueError):
            parse_template(bad)
    assert "''" in t.order[2].draw(random.Random(0), [("it's",)])["status"]


def test_samples_and_workloads_round_trip(db, tmp_path):
    queries = distinct(generate(db, seed=9, tables=(2, 3), filters=(1, 2)), 3)
    runs = sample(db, queries, workers=2)
    assert [r.query for r in runs] == queries and all(r.runtime_ms > 0 and r.plan is not None for r in runs)
    path = str(tmp_path / "samples")
    append_samples(db.spark, runs, path, keep_empty=True)
    append_samples(db.spark, runs, path, keep_empty=True)
    loaded = load_samples(path, db.spark)
    assert len(loaded) == 6 and {q.sql() for q, _ in loaded} == {q.sql() for q in queries}
    assert main(["random", db.sf_dir, str(tmp_path / "sql"), "-n", "2", "--tables", "2", "2"]) == 0
    assert len(load_workload(db.spark, str(tmp_path / "sql"))) == 2


def test_storage_and_cache(db, tmp_path):
    path = str(tmp_path / "x.txt")
    args = (db.spark, path, lambda p: read_text(db.spark, p), lambda: "made", lambda v, p: write_text(db.spark, p, v))
    assert load_or_build(*args) == "made" and load_or_build(*args[:3], lambda: "again", args[4]) == "made"
    assert db.prewarm(["orders", "nation"]) == ["nation", "orders"] and db.cached_fraction("nation") == 1.0 and db.cached_fraction("part") == 0.0
    for t in ("orders", "nation"):
        db.table(t).unpersist()
