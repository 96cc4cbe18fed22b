"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BITS, LEVELS = 10, 3  # each level splits a bucket into 2**BITS buckets; hashes have BITS * LEVELS bits


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A non-null stand-in for the source, so that null joins null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Adds ``target`` (double) and ``full``, ``rest``: whole copies and words of one more, partial copy.

    ``sizes``: one row per source (key, source, source_size).  Shares follow the
    weights; a target stops at ``max_repeats`` times its source's size and the
    excess is reshared by weight until none is above.  In order of size / weight
    the stopped sources are a prefix, so one pass over the sources finds them.
    The sums are of integers; one row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("key"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("total", F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("stopped", F.col("cap") * onward <= F.col("weight") * (F.col("total") - before))
    s = s.withColumn("n", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(everything))
    s = s.withColumn("w", F.sum(F.when(~F.col("stopped"), F.col("weight")).otherwise(0)).over(everything))
    share = F.col("weight") * F.col("n")
    s = s.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.col("w")))
    s = s.withColumn("full", F.when(F.col("stopped"), F.when(F.col("source_size") > 0, max_repeats).otherwise(0)).otherwise(F.expr("(weight * n) div nullif(w * source_size, 0)")).cast("long"))
    s = s.withColumn("rest", F.when(F.col("stopped"), 0.0).otherwise(F.col("target") - F.col("full") * F.col("source_size")))
    return s.select("key", "source_size", "target", "full", "rest")


def _descend(slim: DataFrame, open_: DataFrame, level: int) -> DataFrame:
    """Refines each source's boundary bucket by one level.

    ``open_``: key, prefix (the boundary bucket so far), rest (words still to
    take inside it).  Words are summed by source and sub-bucket of the boundary
    bucket only; the first sub-bucket that exceeds the rest is the new boundary.
    """
    bucket = F.shiftright("h", BITS * (LEVELS - level))
    inside = slim.withColumn("bucket", bucket).join(open_.select("key", "prefix", "rest"), "key").where(F.shiftright("bucket", BITS) == F.col("prefix"))
    sums = inside.groupBy("key", "rest", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("key").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(run))
    over = sums.where(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), "words")).alias("m"))
    return over.select("key", F.col("m.bucket").alias("prefix"), F.col("m.rest").alias("rest"), F.col("m.words").alias("words"))


def _hash(id_col: str, text_col: str) -> Column:
    """Of the id, or of the text where there is none."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("="), F.col(text_col)), F.lit(""))
    h = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.shiftright(h, 60 - BITS * LEVELS)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _hash(id_col, text_col).alias("h"))
    return materialize(slim.withColumn("key", _key("source")), "mixing-sizes")


def _plan(slim: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: key, source_size, target, full copies, and the hash threshold of the partial one."""
    sizes = slim.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeats), "mixing-targets")
    open_ = targets.where("rest > 0").select("key", F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(1, LEVELS + 1):
        open_ = materialize(_descend(slim, open_, level), f"mixing-level{level}")
    edge = open_.select("key", (F.col("prefix") + F.when(F.col("words") - F.col("rest") < F.col("rest"), 1).otherwise(0)).alias("threshold"))
    return materialize(targets.join(edge, "key", "left"), "mixing-plan")


def _copies() -> Column:
    return F.col("full") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Sources in code point order (null last) weigh ``weights``, repeating, and
    share all words of the corpus; see :func:`source_targets`.  A source is
    taken whole ``full`` times; of the partial copy, the documents whose id
    hashes below the source's threshold are taken, and the threshold is found
    by nested histograms, without sorting documents.  In the last level the
    boundary bucket is taken if that comes nearer to the target.

    Returns ``id_col, source_col, size, source_size, target, copies, taken``:
    one row per input row, ``taken = size * copies`` and ``copies`` at most
    ``max_repeats``.

    Null text has size 0; rows with the same id are taken together, and so are
    rows without an id that have the same text.  An empty table gives no rows; a source without words has target
    0.  Further columns of ``docs`` are not read.
    """
    slim = _sizes(docs, id_col, text_col, source_col)
    out = slim.join(_plan(slim, weights, max_repeats), "key", "left").withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as :func:`mix_sources` takes it."""
    plan = _plan(_sizes(docs, id_col, text_col, source_col), weights, max_repeats)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    plan = plan.select(F.col("key").alias("mix_key"), F.col("full").alias("mix_full"), F.col("threshold").alias("mix_threshold"))
    keyed = docs.select(F.struct(*docs.columns).alias("d"), _key(source_col).alias("mix_key"), _hash(id_col, text_col).alias("mix_h"))
    taken = F.col("mix_full") + F.when(F.col("mix_h") < F.col("mix_threshold"), 1).otherwise(0)
    repeated = keyed.join(plan, "mix_key").withColumn("taken", taken.cast("int")).where("taken > 0")
    return repeated.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("taken")))).select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH slim AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '=' || text, '')), 1, 15))::BIGINT >> 30 AS h FROM documents),
src AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM slim GROUP BY 1, 2),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM src),
c AS (SELECT *, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS onward FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, key)),
s AS (SELECT *, cap * onward <= weight * (total - before) AS stopped FROM c),
f AS (SELECT *, total - (sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())::BIGINT AS n, (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::BIGINT AS ws FROM s),
t AS (SELECT key, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE (weight * n)::DOUBLE / ws END AS target,
             CASE WHEN stopped THEN CASE WHEN source_size > 0 THEN 3 ELSE 0 END ELSE (weight * n) // nullif(ws * source_size, 0) END AS full_copies, stopped FROM f),
g AS (SELECT *, CASE WHEN stopped THEN 0 ELSE target - full_copies * source_size END AS rest FROM t),
a AS (SELECT slim.key, h, rest, (sum(size) OVER (PARTITION BY slim.key ORDER BY h RANGE UNBOUNDED PRECEDING))::BIGINT AS upto, sum(size) OVER (PARTITION BY slim.key, h) AS words FROM slim JOIN g USING (key) WHERE rest > 0),
e AS (SELECT key, min(h) AS edge, arg_min(upto, h) AS upto, arg_min(words, h) AS words, any_value(rest) AS rest FROM a WHERE upto > rest GROUP BY key),
p AS (SELECT g.*, e.edge + CASE WHEN e.words - (e.rest - (e.upto - e.words)) < e.rest - (e.upto - e.words) THEN 1 ELSE 0 END AS threshold FROM g LEFT JOIN e USING (key))
SELECT doc_id, size, source_size, target, (size * (full_copies + CASE WHEN h < threshold THEN 1 ELSE 0 END))::BIGINT AS taken FROM slim JOIN p USING (key)
"""
