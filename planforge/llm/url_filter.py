"""URL filtering by rules and by empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NUMBER = r"/(\d{1,15})(?:\.[a-z]+)?/?\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD_RATE, Z = 0.5, 1.0
MAX_RULES = 500
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_match(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does; ties go to block, then by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] != "block", [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """Last two labels of the host (there is no public-suffix list here)."""
    return F.substring_index(host, ".", -2)


def _prior(groups: DataFrame, mean: Column) -> float:
    """Strength of a beta prior around ``mean`` by the method of moments over groups (n, bad)."""
    n, x, m = F.col("n").cast("double"), F.col("bad").cast("double"), mean
    row = groups.where("n > 0").agg(
        F.sum((x - n * m) * (x - n * m) / n).alias("s"), F.sum(m * (1 - m)).alias("v"), F.sum((n - 1) * m * (1 - m)).alias("u")
    ).first()
    if row.s is None or not row.u:
        return MAX_STRENGTH
    rho = (row.s - row.v) / row.u  # expected: v * 1 + u * rho
    return MAX_STRENGTH if rho <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, (1 - rho) / rho))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """Adds ``bad_mean, bad_bound`` to a table of (host, n, bad): labelled pages and bad ones among them.

    The corpus mean shrinks each suffix, the suffix its registered domains and
    the domain its hosts; each level's prior strength is estimated from the
    level's own spread.  ``bad_bound`` is the lower ``Z``-sigma bound of the
    host's posterior, taken as normal with the beta distribution's mean and
    variance (SQL has no beta quantile).
    """
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", F.substring_index("host", ".", -1))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total.bad or 0) + 1.0) / ((total.n or 0) + 2.0)
    k = _prior(suffixes, F.lit(mean))
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * mean) / (F.col("n") + k)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix")
    k = _prior(domains, F.col("suffix_mean"))
    domains = domains.select("domain", ((F.col("bad") + k * F.col("suffix_mean")) / (F.col("n") + k)).alias("domain_mean"))
    hosts = materialize(hosts.join(domains, "domain"), "url-hosts")
    k = _prior(hosts, F.col("domain_mean"))
    m = (F.col("bad") + k * F.col("domain_mean")) / (F.col("n") + k)
    hosts = hosts.select("host", m.alias("bad_mean"), (F.col("n") + k + 1).alias("weight"))
    return hosts.select("host", "bad_mean", (F.col("bad_mean") - Z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / F.col("weight"))).alias("bad_bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judges every url by the longest rule that fits, else by its host's reputation.

    ``outcomes`` (host, bad: boolean): one row per labelled page; null outcomes
    do not count.  A url without a rule is blocked if the posterior bound of
    its host's bad rate is at least ``BAD_RATE``, otherwise allowed.

    Returns ``id_col, host, path, rule, verdict, bad_bound``: one row per input
    row, repeated rows included.  Null urls and urls without ``://`` have empty
    parts and share the empty host.  Hosts without labels fall back on their
    domain; without any label the bound is the flat prior's.  Further columns
    are not read.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labelled = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    every = parts.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(labelled, "host", "full").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    known = materialize(host_reputation(materialize(every, "url-labels")), "url-reputation")
    rule, verdict = rule_match(rules, F.col("host"), F.col("path"))
    judged = parts.join(known.select("host", "bad_bound"), "host", "left")
    fallback = F.when(F.col("bad_bound") >= BAD_RATE, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), "bad_bound")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: labels of the document whose number ends a url's path; bad means low quality or toxic.

    The number is the whole last segment, of 15 digits at most, but for an extension or a slash after it.
    """
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    host, path = url_parts(F.col("url"))
    number = F.try_to_number(F.nullif(F.regexp_extract(path, NUMBER, 1), F.lit("")), F.lit("9" * 15)).cast("long")
    numbered = pages.select(host.alias("host"), number.alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("host", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter(pages, outcomes).drop("bad_bound")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
labelled AS (
  SELECT host, count(*) AS n, sum((quality = 0 OR toxic = 1)::BIGINT)::BIGINT AS bad
  FROM parts JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '/(\d{1,15})(?:\.[a-z]+)?/?\z', 1), '') AS BIGINT)
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY host),
hosts AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
         array_to_string(list_slice(str_split(host, '.'), -2, -1), '.') AS domain, list_extract(str_split(host, '.'), -1) AS suffix
  FROM (SELECT DISTINCT host FROM parts) LEFT JOIN labelled USING (host)),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
m0 AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS m FROM suffixes),
r1 AS (SELECT (sum((bad - n * m) * (bad - n * m) / n) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM suffixes, m0 WHERE n > 0),
k1 AS (SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - rho) / rho)) END AS k FROM r1),
s AS (SELECT suffix, (bad + k * m) / (n + k) AS m1 FROM suffixes, m0, k1),
d AS (SELECT domains.*, m1 AS m FROM domains JOIN s USING (suffix)),
r2 AS (SELECT (sum((bad - n * m) * (bad - n * m) / n) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM d WHERE n > 0),
k2 AS (SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - rho) / rho)) END AS k FROM r2),
h AS (SELECT host, hosts.n, hosts.bad, (d.bad + k * d.m) / (d.n + k) AS m FROM hosts JOIN d USING (domain), k2),
r3 AS (SELECT (sum((bad - n * m) * (bad - n * m) / n) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0) AS rho FROM h WHERE n > 0),
k3 AS (SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - rho) / rho)) END AS k FROM r3),
p AS (SELECT host, (bad + k * m) / (n + k) AS pm, n + k + 1 AS weight FROM h, k3),
known AS (SELECT host, pm - 1.0 * sqrt(pm * (1 - pm) / weight) AS bound FROM p)
SELECT page_id, host, path, v.rule, coalesce(v.verdict, CASE WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN {'rule': 'example.net/en/', 'verdict': 'allow'}
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN {'rule': 'example.com/de/', 'verdict': 'block'}
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN {'rule': 'org/fr/', 'verdict': 'allow'}
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN {'rule': 'net/', 'verdict': 'block'} END AS v
  FROM parts) LEFT JOIN known USING (host)
"""
