import random
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from planforge.llm.decontaminate import decontaminate
from planforge.llm.language import identify_language
from planforge.llm.minhash import near_duplicates


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in P.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"] and P.ORACLE_SQL is None
    stage = dict(P.STAGES)
    told = stage["language ID"](spark, docs, data)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in told.collect()}
    scores = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs).collect()}
    assert told.columns == columns and kept == {i for i, (lang, score) in scores.items() if lang != "und" and score >= P.LEAST_SCORE}
    assert {i for i, t in texts.items() if not any(c.isalpha() for c in t)} <= texts.keys() - kept and len(kept) > 0.95 * len(texts)
    one = stage["MinHash near-dedup"](spark, told, data)
    want = {r.doc_id for r in near_duplicates(told).collect() if r.kept}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want and 0 < len(want) < before
    clean = stage["benchmark decontamination"](spark, one, data)
    found = {r.doc_id for r in decontaminate(one, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want - found
    mixed = stage["mixing sources to target weights"](spark, clean, data)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(copies.values()) <= 3 and set(copies) <= want - found
    placed = stage["sharding"](spark, mixed, data).collect()
    assert Counter(r.doc_id for r in placed) == copies and len({(r.shard, r.slot) for r in placed}) == len(placed)


def test_stages_survive_edges(spark, data, nasty, empty):
    for docs in (nasty.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in P.STAGES:
            docs_out = stage(spark, docs, data)
            assert set(docs.columns) <= set(docs_out.columns)
            docs_out.collect()


def test_run_is_the_chain_of_stages(spark, data):
    rows = P.run(spark, data).collect()
    assert rows and Counter(r.shard for r in rows).keys() <= set(range(8))


def test_one_row_of_each_group_is_left(spark, data):
    """Equal rows, near copies under one id and groups without ids leave one row; rows without words all stay."""
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    a, b, c = words("a", 80), words("b", 80), words("c", 80)
    rows = [(1, a, "en", s, 1) for s in ("z", "y", "y", None, "x")] + [(1, f"{a} {k}", "en", "s", 1) for k in range(4)] + [(7, a, "en", "s", 1), (None, a, "en", "s", 1)]
    rows += [(None, b, "en", "s", 1)] * 5 + [(None, f"{b} {k}", "en", "s", 1) for k in range(3)]
    rows += [(None, None, "en", "s", 1)] * 2 + [(3, None, "en", "s", 1)] * 2 + [(4, " \n", "en", "s", 1)] * 2 + [(None, "", "en", "s", 1)] * 2
    rows += [(1, c, "en", "s", 1), (5, words("d", 3), "en", "s", 1), (5, words("d", 3), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.near_dedup_stage(spark, docs, data)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    of = lambda t: [x for x in left if (x[1] or "").startswith(t)]
    assert len(of(a)) == 1 and of(a)[0][0] == 1 and len(of(b)) == 1 and of(c) == [(1, c)] and of("dw0") == [(5, words("d", 3))]
    assert Counter(x for x in left if not (x[1] or "").strip()) == Counter({(None, None): 2, (3, None): 2, (4, " \n"): 2, (None, ""): 2})
    assert len(left) == 12
    again = P.near_dedup_stage(spark, docs.repartition(7), data)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.collect()))
    unique = docs.where("doc_id = 7 or text is null")
    assert Counter(map(tuple, P.near_dedup_stage(spark, unique, data).collect())) == Counter(map(tuple, unique.collect()))


def test_language_stage_without_languages(spark, data, nasty):
    """Nothing to learn from (no lang, or no doc_id): only null and letterless texts go."""
    docs = nasty.select("doc_id", "text", "lang", "source", "n_chars")
    for column in ("lang", "doc_id"):
        bare = docs.withColumn(column, F.lit(None).cast(dict(docs.dtypes)[column]))
        want = Counter(tuple(r) for r in bare.collect() if any(c.isalpha() for c in r.text or ""))
        got = P.language_stage(spark, bare, data)
        assert got.columns == docs.columns and want and Counter(map(tuple, got.collect())) == want


def test_nulls_in_other_columns_do_not_merge_rows(spark, data):
    """Rows that differ only in which column is null stay two rows, here and in their places."""
    rows = [(1, "same text a", "en", None, 5), (1, "same text a", None, "en", 5), (2, "b b", None, None, None), (2, "b b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = P.sharding_stage(spark, docs, data).collect()
    assert Counter(tuple(r)[:5] for r in placed) == Counter(rows) and len({(r.shard, r.slot) for r in placed}) == 4
    once = [tuple(r) for r in P.near_dedup_stage(spark, docs, data).collect()]
    assert len(once) == 2 and set(once) <= set(rows)


def _shuffled(spark, run):
    """Bytes that the jobs of ``run`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())))
    before = written()
    run()
    return written() - before


def test_kept_texts_are_not_shuffled_where_no_table_is_small_enough_to_broadcast(spark, data):
    """Near-duplicates and leaks are taken out without a shuffle of the texts that stay."""
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(1500))
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(i, text(), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, f"{rows[i][1]} x", "en", "s", 1) for i in range(2)] + [rows[2], (2000, f"{item} {text()}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).localCheckpoint()
    size = sum(len(r[1]) for r in rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for stage, want in ((P.near_dedup_stage, {*range(150), 2000}), (P.decontamination_stage, {*range(150), 1000, 1001})):
            moved = _shuffled(spark, lambda: got.append(stage(spark, docs, data).collect()))  # noqa: B023
            assert {r.doc_id for r in got[-1]} == want and moved < size / 3
        assert len(got[0]) == 151 and len(got[1]) == 153
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
