"""NULL semantics and edge cases, which the driver's tables do not have."""

from pyspark.sql import functions as F

from planforge.functions import scalars as S
from planforge.operators import columns as C
from planforge.operators import degrees as D
from planforge.operators import histograms as H
from planforge.operators import trigrams as G
from planforge.operators.ordered import ordered_scan


def nulls(spark):
    return spark.createDataFrame([(None, 1), (None, 1), (1, 1), (2, 2), (2, None)], "v int, j int")


def test_null_values_are_counted_but_never_join(spark):
    df = nulls(spark)
    assert sorted(map(tuple, C.column_distribution(df, "v").collect()), key=repr) == [(1, 1), (2, 2), (None, 2)]
    assert (None, 0) in set(map(tuple, C.column_count(df, "v").collect()))
    assert sorted(map(tuple, D.degrees(df, "j").collect())) == [(1, 3), (2, 1)]
    assert [tuple(r) for r in C.mcv(df, "v", 1).collect()] == [(None, 2)]
    assert C.max_freq(df, "j").first()[0] == 3


def test_empty_tables(spark):
    df = nulls(spark).limit(0)
    assert D.degree_sequence(df, "j").count() == 0
    assert D.join_bound(D.degrees(df, "j"), D.degrees(nulls(spark), "j")).first()[0] == 0
    assert C.uniform_freq(df, "j").first()[0] == 1
    assert D.valid_compress(D.degrees(df, "j"), 0.01).count() == 0
    assert H.bucket_edges(df, "v", 3) == [[], [], []]


def test_long_runs_unroll_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(map(tuple, D.degree_sequence(df, "k").collect())) == [(i, 1) for i in range(1, 11)]


def test_ordered_scan_numbers_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = ordered_scan(df.repartition(7), [F.asc("x")], number="n", sums={"s": "x"}).collect()
    assert all(r.n == r.x + 1 and r.s == r.x * (r.x + 1) // 2 for r in got) and len(got) == 1000


def test_trigrams_of_short_and_null_strings(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,)], "s string")
    assert sorted(r.gram for r in G.exploded(df, "s").collect()) == ["abc", "bcd"]
    assert G.pattern_parts("%ab%cde%") == ["ab", "cde"] and G.pattern_trigrams("%ab%cde%") == ["cde"]
    assert G.pattern_trigrams("abc_def") == ["abc", "def"]


def test_scalar_edges(spark):
    one = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int")
    assert {r.enc for r in S.minmax_encode(one, "k", "v").collect()} == {0.0}
    abc = spark.createDataFrame([("abc",)], "s string").select(S.hash_encode("s").alias("e")).first().e
    assert abc == 0.6887
    row = one.limit(1).select(S.log_denormalize(S.log_normalize(F.lit(99.0), 500.0, 12), 500.0).alias("x")).first()
    assert abs(row.x - 99) < 1e-6


def test_histogram_levels_nest_and_hold_all_rows(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet")
    levels = H.bucket_edges(df, "p_size", 4)
    assert levels[0] == [] and all(set(a) <= set(b) for a, b in zip(levels, levels[1:], strict=False))
    for edges in levels:
        assert H.level_degrees(df, H.bucket_of("p_size", edges), "p_type").agg(F.sum("deg")).first()[0] == df.count()
    assert levels[1] == [r[0] for r in H.equi_depth_split(df, "p_size").collect()] or len(levels[1]) == 1
