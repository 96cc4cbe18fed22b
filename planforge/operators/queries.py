"""The library's named queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planforge.functions import scalars as S
from planforge.sources.registry import load

from . import columns as C
from . import degrees as D
from . import histograms as H
from . import trigrams as G
from .ordered import ordered_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RIN = "%rin%"


def query(oracle: str | None = None):
    """Registers a function of (table loader) under its name, with its DuckDB equivalent."""

    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda table: load(spark, sf_dir, table))
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return register


# --- columns -------------------------------------------------------------------


@query("SELECT n_name FROM nation WHERE n_name IS NOT NULL")
def column_values(t):
    return C.column_values(t("nation"), "n_name", drop_null=True)


@query("SELECT count(*) AS card FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_card(t):
    return C.filter_card(t("customer"), F.col("c_mktsegment") == "BUILDING")


@query("SELECT count(*) AS card FROM part WHERE p_name LIKE '%rin%'")
def like_cardinality(t):
    return C.like_card(t("part"), "p_name", RIN)


@query("SELECT count(*) AS card FROM part WHERE p_name NOT LIKE '%rin%'")
def not_like_cardinality(t):
    return C.like_card(t("part"), "p_name", RIN, negated=True)


@query("SELECT count(*) AS card FROM part WHERE p_type ILIKE '%sma%'")
def ilike_cardinality(t):
    return C.like_card(t("part"), "p_type", "%sma%", ignore_case=True)


@query("SELECT count(*) AS card FROM part WHERE p_type NOT ILIKE '%sma%'")
def not_ilike_cardinality(t):
    return C.like_card(t("part"), "p_type", "%sma%", negated=True, ignore_case=True)


@query("SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def min_max(t):
    return C.min_max(t("lineitem"), "l_shipdate")


@query("SELECT DISTINCT p_type FROM part")
def distinct_values(t):
    return C.distinct_values(t("part"), "p_type")


@query("SELECT 'orders' AS tbl, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_cardinality(t):
    return C.table_cardinality({"orders": t("orders"), "lineitem": t("lineitem")})


@query("SELECT p_brand, count(p_brand) AS n FROM part GROUP BY p_brand")
def column_count(t):
    return C.column_count(t("part"), "p_brand")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def column_distribution(t):
    return C.column_distribution(t("part"), "p_size")


@query("SELECT p_size, n FROM (SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_size) AS rn FROM part GROUP BY p_size) WHERE rn <= 10")
def mcv_topk(t):
    return C.mcv(t("part"), "p_size", 10)


@query("SELECT max(n) AS mf FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def max_freq(t):
    return C.max_freq(t("lineitem"), "l_suppkey")


@query("SELECT count(*) // count(DISTINCT o_custkey) AS f FROM orders")
def uniform_freq(t):
    return C.uniform_freq(t("orders"), "o_custkey")


@query("""
SELECT CAST(max(n) FILTER (WHERE rn = 1) * max(n) FILTER (WHERE rn = 2) * max(n) FILTER (WHERE rn = 3) AS DOUBLE) AS p
FROM (SELECT n, row_number() OVER (ORDER BY n DESC, t) AS rn FROM (
  SELECT 'l' AS t, count(*) AS n FROM lineitem UNION ALL SELECT 'o', count(*) FROM orders UNION ALL SELECT 'e', count(*) FROM events
  UNION ALL SELECT 'p', count(*) FROM part UNION ALL SELECT 'c', count(*) FROM customer))""")
def top3_card_product(t):
    return C.top_product({n: t(n) for n in ("lineitem", "orders", "events", "part", "customer")})


@query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS freq FROM supplier")
def freq_window(t):
    return C.frequency(t("supplier"), "s_suppkey", "s_nationkey")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY freq, s_suppkey) AS pos FROM (SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS freq FROM supplier)")
def freq_position(t):
    return ordered_scan(C.frequency(t("supplier"), "s_suppkey", "s_nationkey"), [F.asc("freq"), F.asc("s_suppkey")], number="pos").select("s_suppkey", F.col("pos").cast("long").alias("pos"))


# --- degree sequences and bounds -------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rnk, count(*) AS deg FROM lineitem GROUP BY l_suppkey")
def degree_sequence(t):
    return D.degree_sequence(t("lineitem"), "l_suppkey")


@query("SELECT max(n) AS max_deg, min(n) AS min_deg, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS card FROM (SELECT count(*) n FROM orders GROUP BY o_custkey)")
def degree_summary(t):
    return D.degree_summary(t("orders"), "o_custkey")


@query("""
SELECT rnk, deg, CAST(sum(deg) OVER (ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rnk, count(*) AS deg FROM orders GROUP BY o_custkey)""")
def cumulative_degree(t):
    return D.cumulative_degree(t("orders"), "o_custkey")


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY count(*) DESC, c_nationkey) r, count(*) d FROM customer GROUP BY c_nationkey),
b AS (SELECT row_number() OVER (ORDER BY count(*) DESC, s_nationkey) r, count(*) d FROM supplier GROUP BY s_nationkey)
SELECT CAST(sum(a.d * b.d) AS BIGINT) AS bound FROM a JOIN b USING (r)""")
def ds_join_bound(t):
    return D.join_bound(D.degrees(t("customer"), "c_nationkey"), D.degrees(t("supplier"), "s_nationkey"))


@query("SELECT CAST(sum(n * n) AS BIGINT) AS bound FROM (SELECT count(*) n FROM lineitem GROUP BY l_partkey)")
def selfjoin_bound(t):
    return D.selfjoin_size(t("lineitem"), "l_partkey")


def _scalars(**frames: DataFrame) -> DataFrame:
    """One-row frames with one column each, side by side."""
    out = None
    for name, df in frames.items():
        row = df.toDF(name)
        out = row if out is None else out.join(F.broadcast(row))  # one row
    return out


@query("""
WITH s AS (SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') nc, (SELECT count(*) FROM supplier) ns,
  (SELECT max(n) FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey)) mc, (SELECT max(n) FROM (SELECT count(*) n FROM supplier GROUP BY s_nationkey)) ms)
SELECT least(nc * ms, ns * mc) AS bound FROM s""")
def ues_join_bound(t):
    c, s = t("customer"), t("supplier")
    v = _scalars(nc=C.filter_card(c, F.col("c_mktsegment") == "BUILDING"), ns=C.filter_card(s, F.lit(True)), mc=C.max_freq(c, "c_nationkey"), ms=C.max_freq(s, "s_nationkey"))
    return v.select(F.least(F.expr("nc * ms"), F.expr("ns * mc")).alias("bound"))


@query("""
SELECT least((SELECT count(*) FROM orders WHERE o_orderstatus = 'F'),
  (SELECT max(n) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey)) * (SELECT count(*) FROM customer WHERE c_acctbal < 0)) AS bound""")
def ues_pkfk_bound(t):
    o, c = t("orders"), t("customer")
    v = _scalars(no=C.filter_card(o, F.col("o_orderstatus") == "F"), mo=C.max_freq(o, "o_custkey"), nc=C.filter_card(c, F.col("c_acctbal") < 0))
    return v.select(F.least(F.col("no"), F.expr("mo * nc")).alias("bound"))


@query("SELECT o_custkey, count(*) AS deg FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def cond_degree_eq(t):
    return D.degrees(t("orders"), "o_custkey", where=F.col("o_orderstatus") == "F")


@query("SELECT l_suppkey, count(*) AS deg FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY l_suppkey")
def cond_degree_range(t):
    return D.degrees(t("lineitem"), "l_suppkey", where=F.col("l_quantity").between(10, 20))


@query("SELECT l.l_partkey, count(*) AS deg FROM lineitem l JOIN part p ON l_partkey = p_partkey WHERE p_name LIKE '%rin%' GROUP BY l.l_partkey")
def cond_degree_like(t):
    return D.degrees(t("lineitem"), "l_partkey").join(t("part").where(F.col("p_name").like(RIN)).select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("""
SELECT l_returnflag, rnk, deg FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) AS rnk, count(*) AS deg
FROM lineitem GROUP BY l_returnflag, l_suppkey)""")
def eq_conditioned(t):
    by = ("l_returnflag",)
    return D.expand(D.runs(D.degrees(t("lineitem"), "l_suppkey", by=by), by)).select("l_returnflag", "rnk", "deg")


@query("""
WITH m AS (SELECT p_size FROM (SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, p_size) rn FROM part GROUP BY p_size) WHERE rn <= 10)
SELECT p_type, count(*) AS deg FROM part WHERE p_size NOT IN (SELECT p_size FROM m) GROUP BY p_type""")
def non_mcv_degree(t):
    return D.non_mcv_degrees(t("part"), "p_type", "p_size", 10)


@query("""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY count(*) DESC, s_nationkey) r, count(*)::DOUBLE x FROM supplier GROUP BY s_nationkey),
t AS (SELECT 0.01 * sum(x * x) thr FROM d),
f(r, seg, slope, err, w) AS (SELECT 1::BIGINT, 0::BIGINT, x, 0.0::DOUBLE, 1.0::DOUBLE FROM d WHERE r = 1 UNION ALL
  SELECT d.r, CASE WHEN f.err + f.slope * d.x - d.x * d.x >= t.thr THEN f.seg + 1 ELSE f.seg END,
         CASE WHEN f.err + f.slope * d.x - d.x * d.x >= t.thr THEN d.x ELSE f.slope END,
         CASE WHEN f.err + f.slope * d.x - d.x * d.x >= t.thr THEN 0.0 ELSE f.err + f.slope * d.x - d.x * d.x END,
         CASE WHEN f.err + f.slope * d.x - d.x * d.x >= t.thr THEN 1.0 ELSE d.x / f.slope END FROM f JOIN d ON d.r = f.r + 1, t)
SELECT seg, slope, round(sum(w), 4) AS width FROM f GROUP BY seg, slope""")
def valid_compress(t):
    return D.valid_compress(D.degrees(t("supplier"), "s_nationkey"), 0.01).select("seg", "slope", F.round("width", 4).alias("width"))


@query("""
WITH a(lo, hi, v) AS (VALUES (0, 10, 10), (10, 15, 5), (15, 20, 1)), b(lo, hi, v) AS (VALUES (0, 5, 5), (5, 20, 4))
SELECT least(a.hi, b.hi) AS bound, a.v AS va, b.v AS vb, a.v + b.v AS s, a.v * b.v AS p, least(a.v, b.v) AS m FROM a JOIN b ON a.lo < b.hi AND b.lo < a.hi""")
def pcf_align(t):
    from .piecewise import Constant, align

    a, b = Constant([10, 5, 1], [10, 15, 20]), Constant([5, 4], [5, 20])
    bounds, va, vb = align(a, b)
    rows = [(int(u), int(x), int(y), int(x + y), int(x * y), int(min(x, y))) for u, x, y in zip(bounds, va, vb, strict=True)]
    return t("region").sparkSession.createDataFrame(rows, "bound int, va int, vb int, s int, p int, m int")


# --- trigrams and histograms -----------------------------------------------------


@query("SELECT p_partkey, substring(p_name, i, 3) AS gram FROM (SELECT p_partkey, p_name, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3)")
def trigrams(t):
    return G.exploded(t("part"), "p_name", "p_partkey")


@query("SELECT gram, count(*) AS n FROM (SELECT substring(p_name, i, 3) AS gram FROM (SELECT p_name, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3)) GROUP BY gram")
def trigram_counts(t):
    return G.trigram_counts(t("part"), "p_name")


@query("""
SELECT gram, n, dense_rank() OVER (ORDER BY n DESC) AS rnk FROM (SELECT substring(p_name, i, 3) AS gram, count(*) AS n
FROM (SELECT p_name, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3) GROUP BY 1)""")
def trigram_rank(t):
    return G.trigram_rank(t("part"), "p_name")


_GRAMS = """
WITH g AS (SELECT p_size, substring(p_name, i, 3) AS gram FROM (SELECT p_size, p_name, unnest(generate_series(1, length(p_name) - 2)) AS i FROM part WHERE length(p_name) >= 3)),
r AS (SELECT gram, dense_rank() OVER (ORDER BY count(*) DESC) rk FROM g GROUP BY gram) """


@query(_GRAMS + "SELECT g.gram, g.p_size, count(*) AS deg FROM g JOIN r USING (gram) WHERE rk <= 10 GROUP BY g.gram, g.p_size")
def trigram_frequent(t):
    return G.frequent_trigram_degrees(t("part"), "p_name", "p_size", 10)


@query(_GRAMS + "SELECT g.p_size, count(*) AS deg FROM g JOIN r USING (gram) WHERE rk > 10 GROUP BY g.p_size")
def trigram_rare(t):
    return G.rare_trigram_degrees(t("part"), "p_name", "p_size", 10).select("p_size", F.col("deg").cast("long").alias("deg"))


@query("""
WITH d AS (SELECT p_size, count(*) n FROM part GROUP BY p_size),
c AS (SELECT p_size, n, CAST(sum(n) OVER (ORDER BY p_size) AS BIGINT) cum, CAST(sum(n) OVER () AS BIGINT) tot FROM d)
SELECT min(p_size) AS cutoff FROM c WHERE cum > tot // 2""")
def equi_depth_split(t):
    return H.equi_depth_split(t("part"), "p_size")


@query("SELECT CASE WHEN p_size < 26 THEN 0 ELSE 1 END AS bucket, p_type, count(*) AS deg FROM part GROUP BY 1, 2")
def hist_level_counts(t):
    return H.level_degrees(t("part"), H.bucket_of("p_size", [25]), "p_type")


@query("SELECT max(lvl) AS lvl FROM (VALUES (0, 1, 50), (1, 1, 25), (1, 26, 50), (2, 1, 12), (2, 13, 25)) t(lvl, lo, hi) WHERE lo <= 14 AND hi >= 20")
def range_bucket_lookup(t):
    buckets = t("region").sparkSession.createDataFrame([(0, 1, 50), (1, 1, 25), (1, 26, 50), (2, 1, 12), (2, 13, 25)], "lvl int, lo int, hi int")
    return H.range_lookup(buckets, 14, 20)


# --- joins -----------------------------------------------------------------------


def _ues(sql: str, hint: str | None = "SHUFFLE_HASH"):
    """Plans the query by its upper bounds and builds it as ordered, hinted DataFrame joins."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from planforge.plans.parse import parse_query
        from planforge.sources.registry import Database

        from .join_order import PreciseStats, build, optimize

        db, spec = Database(spark, sf_dir), parse_query(sql)
        tree = optimize(spec, PreciseStats(db), db.schema)
        return build(spec, tree, db, hint=hint).agg(F.count(F.lit(1)).alias("n"))

    return run


SPJ = {
    "spj_2way": "SELECT count(*) AS n FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    "spj_4way": "SELECT count(*) AS n FROM region r, nation n, customer c, orders o WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey AND r.r_name = 'ASIA'",
    "spj_6way_ues": "SELECT count(*) AS n FROM lineitem l, orders o, customer c, supplier s, nation n, part p WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND l.l_partkey = p.p_partkey AND p.p_size < 10",
    "spj_nm_ues": "SELECT count(*) AS n FROM customer c, supplier s, orders o WHERE c.c_nationkey = s.s_nationkey AND o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' AND s.s_acctbal > 0",
}
for _name, _sql in SPJ.items():
    QUERIES[_name], ORACLE_SQL[_name] = _ues(_sql), _sql


#: Filters on one join, with literals of each type, written as a user would write them.
BOUNDED = {
    "all": "",
    "double = integer": "AND l.l_quantity = 10",
    "double = decimal": "AND l.l_quantity = 10.0",
    "double in": "AND l.l_quantity IN (10, 20, 30.0)",
    "double range": "AND l.l_quantity <= 7",
    "double between": "AND l.l_quantity BETWEEN 12 AND 30",
    "unseen": "AND l.l_quantity = 1234567",
    "string": "AND o.o_orderstatus = 'F'",
    "two sides": "AND l.l_quantity > 45 AND o.o_orderstatus = 'O'",
}


def _bounded(condition: str) -> str:
    return f"SELECT count(*) AS n FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey {condition}"


def catalog_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the bound catalog that a workload needs and holds its bounds against the exact sizes: (name, n, ok)."""
    from planforge.plans.parse import parse_query
    from planforge.sources.registry import Database

    from .catalog import Catalog, Settings, Wanted
    from .join_order import PreciseStats, build, optimize

    db, specs = Database(spark, sf_dir), {name: parse_query(_bounded(c)) for name, c in BOUNDED.items()}
    catalog = Catalog.build(db, Wanted.from_workload(list(specs.values())), Settings(common=20, depth=3))
    out, stats = None, PreciseStats(db)
    for name, spec in specs.items():
        n = build(spec, optimize(spec, stats, db.schema), db).agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(name).alias("name"), "n", (F.lit(catalog.estimate(spec) + 1e-6) >= F.col("n")).alias("ok"))
        out = row if out is None else out.unionAll(row)
    return out


QUERIES["catalog_bounds"] = catalog_bounds
ORACLE_SQL["catalog_bounds"] = " UNION ALL ".join(f"SELECT '{name}' AS name, n, true AS ok FROM ({_bounded(c)})" for name, c in BOUNDED.items())


def generated_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty generated queries: whether the ordered joins and the query's own SQL text count the same rows, and the bound holds (i, same, ok)."""
    from planforge.plans.parse import parse_query
    from planforge.sources.registry import Database
    from planforge.workload.random_spj import distinct, generate

    from .join_order import PreciseStats, build, optimize

    db, out = Database(spark, sf_dir), None
    stats = PreciseStats(db)
    views = {t: f"_generated_{t}" for t in db.schema.tables}
    for t, view in views.items():
        db.table(t).createOrReplaceTempView(view)
    for i, spec in enumerate(distinct(generate(db, seed=7, tables=(2, 3), filters=(1, 3)), 20)):
        again = parse_query(spec.sql())
        tree = optimize(again, stats, db.schema)
        n = build(again, tree, db).agg(F.count(F.lit(1)).alias("n"))
        text = to_views(spec, views)
        m = spark.sql(text).toDF("m")
        row = n.join(F.broadcast(m)).select(F.lit(i).cast("long").alias("i"), (F.col("n") == F.col("m")).alias("same"), (F.col("n") <= F.lit(float(tree.bound) + 1e-6)).alias("ok"))  # one row each
        out = row if out is None else out.unionAll(row)
    return out


def to_views(spec, views: dict[str, str]) -> str:
    """The query's SQL over other names of its tables; its aliases stay."""
    from dataclasses import replace

    return replace(spec, tables={a: views[t] for a, t in spec.tables.items()}).sql()


QUERIES["generated_workload"] = generated_workload
ORACLE_SQL["generated_workload"] = "SELECT i, true AS same, true AS ok FROM range(20) t(i)"


# --- encodings -------------------------------------------------------------------


@query("SELECT event_type, round(sum(value * pow(0.8, n - rn)), 2) AS cost FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) rn, count(*) OVER (PARTITION BY event_type) n FROM events) GROUP BY event_type")
def tonic_cost_fold(t):
    from .synopsis import cost_fold

    return cost_fold(t("events"), "event_type", "event_id", "value", gamma=0.8).select("event_type", F.round("cost", 2).alias("cost"))


@query("SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id DESC) rn FROM events) WHERE rn <= 2000")
def experience_window(t):
    return t("events").select("event_id", "value").orderBy(F.desc("event_id")).limit(2000)


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS enc FROM part")
def minmax_encode(t):
    return S.minmax_encode(t("part"), "p_partkey", "p_size")


@query("SELECT p_partkey, round((p_size + 0.001::DOUBLE - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER () + 0.001::DOUBLE), 4) AS enc FROM part")
def fg_minmax_encode(t):
    return S.offset_encode(t("part"), "p_partkey", F.col("p_size"), 0.001)


@query("SELECT o_orderkey, round((epoch(o_orderdate) + 86400 - min(epoch(o_orderdate)) OVER ()) / (max(epoch(o_orderdate)) OVER () - min(epoch(o_orderdate)) OVER () + 86400), 4) AS enc FROM orders")
def fg_time_encode(t):
    return S.offset_encode(t("orders"), "o_orderkey", S.epoch("o_orderdate"), 86400.0)


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS ep FROM orders")
def epoch_encode(t):
    return t("orders").select("o_orderkey", S.epoch("o_orderdate").alias("ep"))


@query("SELECT p_partkey, round((dense_rank() OVER (ORDER BY p_name) - 1) / (SELECT count(DISTINCT p_name) FROM part)::DOUBLE, 6) AS enc FROM part")
def ordinal_encode(t):
    return S.ordinal_encode(t("part"), "p_partkey", "p_name")


@query("SELECT p_type, round((idx + 1) / (mx + 1)::DOUBLE, 4) AS enc FROM (SELECT p_type, row_number() OVER (ORDER BY count(*), p_type) - 1 AS idx, count(*) OVER () - 1 AS mx FROM part GROUP BY p_type)")
def fg_label_encode(t):
    return S.label_encode(t("part"), "p_type")


@query("SELECT DISTINCT p_name, round((md5_number_upper(p_name)::DOUBLE + 1) / (18446744073709551616::DOUBLE + 1), 4) AS enc FROM part")
def fg_hash_encode(t):
    return t("part").select("p_name").distinct().select("p_name", S.hash_encode("p_name").alias("enc"))


@query("SELECT round((count(*) FILTER (WHERE p_name LIKE '%rin%') + 0.001::DOUBLE) / (count(*) + 0.001::DOUBLE), 4) AS enc FROM part")
def fg_wildcard_encode(t):
    return S.wildcard_encode(t("part"), "p_name", RIN)


@query("SELECT o_orderkey, round(least(greatest(ln(1 + o_totalprice) / ln(1 + 500000.0::DOUBLE), 0), 1), 6) AS y FROM orders")
def log_normalize(t):
    return t("orders").select("o_orderkey", S.log_normalize(F.col("o_totalprice"), 500000.0).alias("y"))


@query("SELECT s_suppkey, round(greatest(e / t, t / e), 6) AS q FROM (SELECT s_suppkey, greatest(abs(s_acctbal), 1) e, greatest(s_nationkey::DOUBLE, 1) t FROM supplier)")
def qerror(t):
    return t("supplier").select("s_suppkey", F.round(S.qerror(F.abs("s_acctbal"), F.col("s_nationkey").cast("double")), 6).alias("q"))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'MACHINERY')::INT AS machinery FROM customer")
def onehot_segment(t):
    return t("customer").select("c_custkey", S.one_hot("c_mktsegment", "BUILDING").alias("building"), S.one_hot("c_mktsegment", "MACHINERY").alias("machinery"))


@query("SELECT hs, b, (hs >> b) & 1 AS on_bit FROM range(64) t(hs), range(6) u(b)")
def hintset_bits(t):
    spark = t("region").sparkSession
    sets = spark.range(64).select(F.col("id").alias("hs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("b"))
    return sets.select("hs", "b", S.bit(F.col("hs"), F.col("b")).cast("long").alias("on_bit"))


@query("SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def best_label(t):
    """The cheapest run of each query that did not fail; a partial aggregation, not a sort per query."""
    best = t("events").where("event_type <> 'error'").groupBy("user_id").agg(F.min(F.struct("value", "event_id", "event_type")).alias("m"))
    return best.select("user_id", "m.event_type", "m.value")


@query("SELECT event_type, round((count(*) FILTER (WHERE value > 50) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE), 6) AS ratio FROM events GROUP BY event_type")
def success_ratio(t):
    g = t("events").groupBy("event_type").agg(F.sum((F.col("value") > 50).cast("long")).alias("better"), F.count(F.lit(1)).alias("used"))
    return g.select("event_type", F.round(S.success_ratio(F.col("better"), F.col("used")), 6).alias("ratio"))


# --- flagship --------------------------------------------------------------------


def bound_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on a filtered n:m join beside its exact size: (what, n)."""
    c, s = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), load(spark, sf_dir, "supplier")
    rank = D.join_bound(D.degrees(c, "c_nationkey"), D.degrees(s, "s_nationkey")).select(F.lit("rank bound").alias("what"), F.col("bound").alias("n"))
    ues = QUERIES["ues_join_bound"](spark, sf_dir).select(F.lit("frequency bound").alias("what"), F.col("bound").alias("n"))
    per_nation = c.groupBy("c_nationkey").count().join(s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("m")), F.col("c_nationkey") == F.col("s_nationkey"))
    exact = per_nation.agg(F.sum(F.col("count") * F.col("m")).alias("n")).select(F.lit("exact").alias("what"), "n")
    return rank.union(ues).union(exact)


QUERIES["bound_report"] = bound_report
ORACLE_SQL["bound_report"] = """
WITH c AS (SELECT c_nationkey k, count(*) d FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), s AS (SELECT s_nationkey k, count(*) d FROM supplier GROUP BY 1),
cr AS (SELECT d, row_number() OVER (ORDER BY d DESC, k) r FROM c), sr AS (SELECT d, row_number() OVER (ORDER BY d DESC, k) r FROM s)
SELECT 'rank bound' AS what, CAST(sum(cr.d * sr.d) AS BIGINT) AS n FROM cr JOIN sr USING (r) UNION ALL
SELECT 'frequency bound', least((SELECT sum(d) FROM c) * (SELECT max(d) FROM s), (SELECT sum(d) FROM s) * (SELECT max(n) FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey)))::BIGINT UNION ALL
SELECT 'exact', CAST(sum(c.d * s.d) AS BIGINT) FROM c JOIN s USING (k)"""
