import numpy as np
import pytest
from pyspark.sql import functions as F

from planforge.functions.encoders import Numeric, Text, Time, encoder_from_json, encoder_json, fit_encoder
from planforge.learned.contexts import ContextClassifier, Encodings, context_key, context_of, differing, featurize, merged, super_contexts, without
from planforge.learned.hints import CORE, HintSet
from planforge.learned.labels import Experience as LabelExperience
from planforge.learned.labels import Search, best_labels, label_query, trials_frame
from planforge.learned.plan_choice import Experience, PlanChooser, PlanFeatures, TreeModel, arms
from planforge.learned.set_model import CardinalityModel, Featurizer, SetModel, qerror_loss, qerrors
from planforge.plans.parse import parse_query
from planforge.plans.runtime import PlanNode, execute, physical_plan, plan_key, settings, with_joins
from planforge.sources.registry import Database
from planforge.streaming.experience import ExperienceSink, collect_experience, runtime_windows, sample_stream
from planforge.workload.random_spj import distinct, generate


@pytest.fixture(scope="module")
def db(spark, data):
    return Database(spark, data)


def numeric(loss, params, key, at, eps=1e-5):
    before = params[key][at]
    params[key][at] = before + eps
    up = loss()
    params[key][at] = before - eps
    down = loss()
    params[key][at] = before
    return (up - down) / (2 * eps)


def test_encoders(db):
    n = Numeric(0.0, 10.0)
    assert n.encode(5) == 0.5 and n.decode(0.5) == 5 and n.encode(None) is None and Numeric(3, 3).encode(3) == 0.0
    t = fit_encoder(db, "orders", "o_orderdate")
    assert isinstance(t, Time) and t.encode(t.decode(0.25)) == pytest.approx(0.25)
    s = Text(["a", "b", "d"])
    assert [s.encode(x) for x in ("a", "c", "d", None)] == [0, 2 / 3, 2 / 3, -1] and s.decode(1 / 3) == "b"
    for e in (n, t, s, fit_encoder(db, "part", "p_name")):
        assert encoder_from_json(encoder_json(e)) == e
    with pytest.raises(TypeError):
        fit_encoder(Database(db.spark, db.sf_dir), "embeddings", "embedding")


def test_set_model_gradient():
    rng = np.random.default_rng(0)
    m = SetModel((3, 2, 4), hidden=5)
    batch = [(rng.normal(size=(4, 3, w)), (rng.random((4, 3, 1)) > 0.3).astype(float)) for w in (3, 2, 4)]
    batch[1][1][0] = 0  # an empty set
    target = rng.random(4)
    loss = lambda: qerror_loss(m.forward(batch)[0], target, 100.0)[0]
    y, cache = m.forward(batch)
    grads = m.gradients(cache, qerror_loss(y, target, 100.0)[1])
    for key in ("t0w", "j1w", "p0w", "o0w", "o1b", "p1b"):
        at = tuple(0 for _ in m.params[key].shape)
        assert grads[key][at] == pytest.approx(numeric(loss, m.params, key, at), rel=1e-3, abs=1e-6)


def test_cardinality_model_learns(db, tmp_path):
    for t in db.schema.tables:
        db.table(t).createOrReplaceTempView(t)
    queries = distinct(generate(db, seed=1, tables=(1, 2), filters=(1, 2)), 30)
    samples = [(q, db.spark.sql(q.sql()).first()[0]) for q in queries]
    f = Featurizer.from_workload(db, queries)
    model = CardinalityModel.train(f, samples, hidden=32, epochs=150, rate=3e-3)
    assert model.losses[-1] < 0.5 * model.losses[0]
    pairs = [(model.estimate(q), float(n)) for q, n in samples]
    assert qerrors(pairs, db.spark).agg(F.min("q")).first()[0] >= 1
    model.store(db.spark, str(tmp_path / "m.json"))
    again = CardinalityModel.load(db.spark, str(tmp_path / "m.json"))
    assert again.estimate(queries[0]) == pytest.approx(model.estimate(queries[0]))
    assert Featurizer.from_schema(db).encode(queries[0])[0].sum() == len(queries[0].tables)
    unknown = parse_query("SELECT count(*) FROM nowhere n WHERE n.x = 1")
    assert f.encode(unknown)[0].sum() == 0 and model.estimate(unknown) >= 0


def tree(depth, seed=0):
    rng = np.random.default_rng(seed)
    n = PlanNode("Scan" if depth == 0 else "Join", "", [], int(rng.integers(1, 1000)))
    n.children = [] if depth == 0 else [tree(depth - 1, seed + 1), *([tree(0, seed + 9)] if depth % 2 else [])]
    return n


def test_tree_model_gradient():
    plans = [tree(3), tree(2, 5)]
    f = PlanFeatures.fit(plans, [10.0, 20.0])
    m = TreeModel(f.width, channels=(6, 5, 4))
    t = f.tree(plans[0])
    y, cache = m.forward(t)
    grads = m.gradients(cache, 1.0)
    for key in ("c0w", "c1w", "c2b", "d0w", "d1w"):
        for at in [tuple(0 for _ in m.params[key].shape), tuple(s - 1 for s in m.params[key].shape)]:
            assert grads[key][at] == pytest.approx(numeric(lambda: m.forward(t)[0], m.params, key, at), rel=1e-3, abs=1e-6)
    assert f.milliseconds(f.runtime(15.0)) == pytest.approx(15.0)


def test_plan_chooser_prefers_what_was_fast(spark, data, tmp_path):
    made = arms()
    assert len({(a.conf, a.joins) for a in made}) == len(made) >= 20
    q = lambda: spark.read.parquet(f"{data}/orders.parquet").join(spark.read.parquet(f"{data}/customer.parquet"), F.expr("o_custkey = c_custkey")).groupBy().count()
    c = PlanChooser(spark, [made[0], next(a for a in made if a.joins == ("merge",))], every=1000, epochs=60, rate=3e-3)
    plans = c.plans(q)
    assert {n.name.split(" ")[0] for p in plans for n in p.walk() if n.is_join} >= {"BroadcastHashJoin", "SortMergeJoin"} and len({str([n.name for n in p.walk()]) for p in plans}) == 2
    assert c.predict(plans[0]) == float("inf")
    for _ in range(10):
        c.add(plans[0], 1000.0)
        c.add(plans[1], 10.0)
    c.train()
    assert c.losses[-1] < c.losses[0] and c.choose(q) == c.arms[1]
    arm, done = c.run(q)
    assert done.rows[0][0] == 1500 and arm == c.arms[1]
    c.store(str(tmp_path / "chooser"))
    again = PlanChooser.load(spark, str(tmp_path / "chooser"))
    assert again.choose(q) == arm and len(again.experience.items) == 21


def test_arms_change_plans(spark, data):
    """Join hints and scan settings: at least ten different plans, and each join operator alone is what is planned."""
    q = lambda: spark.read.parquet(f"{data}/orders.parquet").where("o_totalprice > 1000").join(spark.read.parquet(f"{data}/customer.parquet"), F.expr("o_custkey = c_custkey")).groupBy().count()
    plans = {}
    for arm in arms():
        with settings(spark, {"spark.sql.adaptive.enabled": "false"} | dict(arm.conf)):
            df = arm.apply(q())
            plans[arm] = plan_key(df), tuple(n.name.split(" ")[0] for n in physical_plan(df).walk() if n.is_join)
    assert len(plans) >= 28 and len({key for key, _ in plans.values()}) >= 10
    one = {arm.joins[0]: joins for arm, (_, joins) in plans.items() if len(arm.joins) == 1}
    assert one == {"hash": ("ShuffledHashJoin",), "merge": ("SortMergeJoin",), "broadcast": ("BroadcastHashJoin",)}
    assert with_joins(q(), ("hash",)).first()[0] == q().first()[0] == 1500
    sets = set()
    for bits in range(64):
        with settings(spark, {"spark.sql.adaptive.enabled": "false"} | HintSet(bits).conf()):
            sets.add(plan_key(with_joins(q(), HintSet(bits).joins())))
    assert len(sets) >= 12


def test_execution_bounds_what_comes_to_the_driver(spark):
    with pytest.raises(ValueError):
        execute(spark.range(20_000))
    assert execute(spark.range(20_000), rows=False).rows is None and len(execute(spark.range(50)).rows) == 50


def test_chooser_learns_from_records(spark):
    c = PlanChooser(spark, arms()[:2], every=1000, epochs=5)
    c.calibrate_from([(tree(2), 10.0), (tree(3), 20.0)])
    assert c.predict(tree(2)) < float("inf") and len(c.experience.items) == 2


def test_experience_is_bounded():
    e = Experience(window=3, every=2)
    for i in range(5):
        e.add(tree(0), float(i))
    assert [ms for _, ms in e.items] == [2, 3, 4] and e.due
    e.retrained()
    assert not e.due


def test_hint_sets():
    all_on = HintSet.all_on()
    assert all_on.bits == 63 and [h.bits for h in all_on.neighbours()] == [62, 61, 59, 55, 47, 31]
    assert HintSet(61).disabled() == [CORE[1].name] and HintSet.without([CORE[0].name]).bits == 62 and HintSet(5).binary() == "000101"
    for bad in (lambda: HintSet(64), lambda: HintSet.without(["no such"])):
        with pytest.raises(ValueError):
            bad()


def test_labels(spark, data):
    q = lambda: spark.read.parquet(f"{data}/nation.parquet").groupBy("n_regionkey").count()
    trials = label_query(spark, "q", q, search=Search(levels=2, patience=1))
    assert trials[0].hints.bits == 63 and sum(t.optimal for t in trials) == 1 and any(t.seen_plan for t in trials)
    best = best_labels(trials_frame(spark, trials)).collect()
    assert [r.query_name for r in best] == ["q"] and spark.conf.get("spark.sql.codegen.wholeStage") == "true"
    e = LabelExperience()
    e.note("a", True)
    assert e.ratio("a") == pytest.approx(2 / 3) and e.ratio("b") == 0.5


def test_contexts(db, tmp_path):
    queries = [parse_query(f"SELECT count(*) FROM orders o WHERE o.o_orderstatus = '{s}' AND o.o_totalprice > {p}") for s in "FO" for p in (1000, 100000, 200000)]
    other = parse_query("SELECT count(*) FROM part p WHERE p.p_name LIKE '%rin%'")
    a, b = context_of(queries[0]), context_of(other)
    assert a == context_of(queries[1]) != b and context_key(a) != context_key(b) and context_of(other, "schema") == frozenset()
    assert super_contexts([frozenset([("a", "")]), frozenset([("a", ""), ("b", "")])])[frozenset([("a", "")])] == frozenset([("a", ""), ("b", "")])
    enc = Encodings.build(db, [*queries, other])
    v = featurize(queries[0], ["orders.o_orderstatus", "orders.o_totalprice", "orders.none"], enc)
    assert len(v) == 12 and v[8:] == [0.0] * 4 and v[:3] == [0.0, 0.0, 1.0] and 0 < v[3] <= 1
    c = ContextClassifier(db.spark, enc)
    c.fit([(q, 63 if "'F'" in q.sql() else 31) for q in queries] + [(other, 7)], trees=10)
    assert [c.predict(q) for q in queries] == [63] * 3 + [31] * 3 and c.predict(other) == 7
    assert c.predict(parse_query("SELECT count(*) FROM nation n")) == 31  # the most frequent label; of equally frequent ones the smallest
    wide = ContextClassifier(db.spark, enc, granularity="table")
    wide.fit([(parse_query("SELECT count(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"), x) for x in (5, 9, 9)] + [(other, 5)] * 4)
    assert wide.predict(queries[0]) == 9 and wide.predict(parse_query("SELECT count(*) FROM nation n")) == 5  # a larger context; the whole workload
    with pytest.raises(ValueError):
        ContextClassifier(db.spark, enc).predict(other)
    x, y = frozenset([("a", ""), ("b", "")]), frozenset([("b", ""), ("c", "")])
    assert (merged(x, y), without(x, y), differing(x, y)) == (x | y, frozenset([("a", "")]), frozenset([("a", ""), ("c", "")]))
    c.store(str(tmp_path / "ctx"))
    assert [ContextClassifier.load(db.spark, str(tmp_path / "ctx")).predict(q) for q in queries] == [c.predict(q) for q in queries]


def test_stream_of_samples(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"q{i}", "{}", i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "query string, plan string, cardinality long, runtime_ms double").withColumn("ts", F.timestamp_seconds(F.col("cardinality") * 60))
    df.repartition(3).write.parquet(src)
    got = []
    sink = ExperienceSink(dst, lambda d: got.append(sorted(r.cardinality for r in d.collect())), every=20, window=10)
    collect_experience(sample_stream(spark, src, files_per_trigger=1), sink, str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(dst).count() == 29 and len(got) == 1 and len(got[0]) == 10
    q = runtime_windows(sample_stream(spark, src)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 30
