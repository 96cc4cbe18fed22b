import itertools

import pytest

from planforge.operators import bound_tree
from planforge.operators.catalog import Catalog, Settings, Wanted, exact_functions
from planforge.operators.join_order import NativeStats, PreciseStats, build, optimize, result, upper_bound
from planforge.operators.queries import SPJ
from planforge.operators.synopsis import Synopsis, join_path
from planforge.plans.parse import parse_query
from planforge.plans.query import And, Between, Compare, In, Like, Not, Or, operators_used, simple_filters, to_sql
from planforge.plans.runtime import execute, physical_plan, plan_cost, plan_key, settings
from planforge.sources.registry import Database
from planforge.workload.random_spj import distinct, generate


@pytest.fixture(scope="module")
def db(spark, data):
    return Database(spark, data)


def count(db, q):
    for t in q.tables.values():
        db.table(t).createOrReplaceTempView(t)
    return db.spark.sql(q.counting().sql()).first()[0]


def test_parser_round_trip():
    sql = "SELECT c.c_name FROM customer c, orders o WHERE o.o_custkey = c.c_custkey AND (c.c_acctbal > -1.5 OR c.c_name LIKE '%it''s%') AND o.o_orderstatus IN ('F', 'O') AND o.o_totalprice BETWEEN 1 AND 2 AND NOT c.c_nationkey = 3 AND o.o_orderdate IS NOT NULL"
    q = parse_query(sql)
    assert parse_query(q.sql()) == q and len(q.filters) == 5 and len(q.joins) == 1
    assert isinstance(q.filters[0], Or) and isinstance(q.filters[1], In) and isinstance(q.filters[2], Between) and isinstance(q.filters[3], Not)
    assert q.fragment(["c"]).joins == () and q.columns == (("c", "c_name"),)
    for bad in ("SELECT FROM t", "SELECT * FROM a, a", "SELECT * FROM a, b WHERE a.x < b.y", "SELECT * FROM a WHERE a.x ~ 1"):
        with pytest.raises(ValueError):
            parse_query(bad)


def test_visitors():
    p = And((Between(("a", "x"), 1, 2), Or((Compare(("a", "y"), "=", 1), Like(("a", "z"), "%q%", True)))))
    assert [to_sql(x) for x in simple_filters([p])] == ["a.x >= 1", "a.x <= 2"]
    assert sorted(operators_used([p])) == [(("a", "x"), "<="), (("a", "x"), ">="), (("a", "y"), "="), (("a", "z"), "NOT LIKE")]


@pytest.mark.parametrize("name", sorted(SPJ))
def test_ordering_bounds_and_results(db, name):
    q = parse_query(SPJ[name])
    tree = optimize(q, PreciseStats(db), db.schema)
    assert tree.aliases == frozenset(q.tables)
    exact = count(db, q)
    assert build(q, tree, db).count() == exact <= tree.bound
    assert exact <= bound_tree.bound(q, exact_functions(db, q)) * (1 + 1e-9)
    assert upper_bound(q, NativeStats(db), db.schema) > 0


def test_hints_reach_the_plan(db):
    q = parse_query(SPJ["spj_2way"])
    tree = optimize(q, PreciseStats(db), db.schema)
    with settings(db.spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for op, want in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("nested", "CartesianProduct")):
            plan = physical_plan(build(q, tree, db, operators={tree.aliases: op}))
            assert [n.name for n in plan.walk() if n.is_join][0].startswith(want)


def test_cyclic_and_random_queries_are_bounded(db):
    cyclic = parse_query("SELECT count(*) FROM customer c, supplier s, nation n WHERE c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = c.c_custkey")
    assert count(db, cyclic) <= bound_tree.bound(cyclic, exact_functions(db, cyclic)) * (1 + 1e-9)
    for q in distinct(generate(db, seed=5, tables=(2, 4), filters=(0, 2)), 6):
        assert count(db, q) <= bound_tree.bound(q, exact_functions(db, q)) * (1 + 1e-9), q.sql()
        tree = optimize(q, PreciseStats(db), db.schema)
        assert count(db, q) <= tree.bound * (1 + 1e-9), (q.sql(), str(tree))


def test_catalog_bounds_filters(db, tmp_path):
    queries = [parse_query(s) for s in (
        "SELECT count(*) FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey AND p.p_name LIKE '%rin%' AND l.l_quantity BETWEEN 10 AND 20",
        "SELECT count(*) FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F' AND l.l_returnflag IN ('A', 'R')",
        "SELECT count(*) FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey AND (c.c_mktsegment = 'BUILDING' OR c.c_mktsegment = 'nothing') AND s.s_acctbal > 0",
    )]
    made = Catalog.build(db, Wanted.from_workload(queries), Settings(common=20, depth=4), str(tmp_path / "catalog"))
    again = Catalog.load(db, str(tmp_path / "catalog"))
    assert made.count() == again.count() > 20
    for q in queries:
        estimate = made.estimate(q)
        assert count(db, q) <= estimate * (1 + 1e-9) and estimate == again.estimate(q)
    assert made.estimate(queries[0].fragment(["p"])) is None
    plain = parse_query("SELECT count(*) FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey")
    assert made.estimate(queries[0]) < made.estimate(plain)


def test_synopsis_learns_and_round_trips(db, tmp_path):
    q = parse_query(SPJ["spj_4way"])
    tree = optimize(q, PreciseStats(db), db.schema)
    joins = [j.aliases for j in tree.inner_nodes()]
    price = {"hash": 3.0, "merge": 1.0}
    s = Synopsis(filters=True)
    assert s.recommend(q, tree) == {} and set(s.unknown(q, tree, ("hash", "merge"))) == set(joins)
    done = s.explore(q, tree, ("hash", "merge"), lambda ops: {a: price[o] for a, o in ops.items()})
    assert done == 2 ** len(joins) and s.recommend(q, tree) == dict.fromkeys(joins, "merge")
    assert s.unknown(q, tree, ("hash", "merge")) == {} and len(join_path(q, tree)) == len(joins)
    s.store(db.spark, str(tmp_path / "synopsis"))
    t = Synopsis.load(db.spark, str(tmp_path / "synopsis"))
    assert t.rows() == s.rows() and t.describe() == s.describe() and t.filters
    few = Synopsis()
    assert few.explore(q, tree, ("hash", "merge"), lambda ops: {a: 1.0 for a in ops}, most=2) == 2
    once = Synopsis(gamma=0.8)
    for c in (10, 20, 30):
        once.integrate(q, tree, {joins[0]: "hash"}, {joins[0]: c})
    assert [r[3] for r in once.rows()] == [pytest.approx(52.4)]


def test_execution_metrics_timeout_and_keys(spark, db):
    q = parse_query(SPJ["spj_2way"])
    df = result(q, build(q, optimize(q, PreciseStats(db), db.schema), db))
    done = execute(df, timeout=60)
    assert not done.timed_out and done.rows[0][0] == count(db, q) and plan_cost(done.plan) > 0
    assert plan_key(df) == plan_key(result(q, build(q, optimize(q, PreciseStats(db), db.schema), db)))
    slow = spark.range(10**7).crossJoin(spark.range(10**5).withColumnRenamed("id", "b")).selectExpr("sum(hash(id, b)) as h")
    assert execute(slow, timeout=1.0).timed_out


def test_native_join_orders_agree(db):
    q = parse_query(SPJ["spj_nm_ues"])
    exact = count(db, q)
    for order in itertools.permutations(["c", "s", "o"]):
        from planforge.operators.join_order import Tree, _between

        t = Tree(order[0])
        for a in order[1:]:
            t = Tree(None, t, Tree(a), _between(q, t.aliases, frozenset([a])))
        assert build(q, t, db).count() == exact
