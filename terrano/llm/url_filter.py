"""URL rules by host-suffix and path-prefix expressions.

A URL is expanded into every suffix of its host, at label bounds, of as many labels as some rule has, joined
with every prefix of its path whose length some rule has. Expressions meet the rules in an equi-join on the first four bytes of their
SHA-256, the full digests confirm the match, and the longest fitting rule decides.

Defined cases: a null URL or one without '://' has an empty host and path and fits no rule; ports and
user names are part of the host as written; equal rules with different verdicts: block wins; rules with a
null or empty host or a null path or verdict fit nothing; repeated pages are judged alike; other columns are kept
unless they clash with results; with no rules, all pages get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.session import broadcast_within, join_hot, written

#: The rules in production, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
PREFIX_HEX = 8
MAX_BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The host's last labels, for each of the counts that it has."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in counts)))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    ready = rules.where("length(host) > 0 and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host"),
        F.length("path").alias("rule_path"),
        (F.col("verdict") == "block").alias("block"),
    )
    ready = ready.groupBy("rule", "rule_host", "rule_path").agg(F.max("block").alias("block"))
    ready = ready.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.left("digest", F.lit(PREFIX_HEX)))
    # a few of each: path lengths of rules, and label counts of their hosts
    lengths = [r[0] for r in ready.select("rule_path").distinct().collect()]
    labels = [r[0] for r in ready.select((F.size(F.split(F.left("rule", F.col("rule_host")), r"\.")))).distinct().collect()]
    base = pages.drop("host", "path", "rule", "verdict").withColumn("_url", F.col(url))
    counts = written(base.groupBy("_url").agg(F.count("*").alias("c")), "urls")
    urls = counts.select("_url").withColumn("_host", host(F.col("_url"))).withColumn("_path", path(F.col("_url")))
    ends = F.filter(F.array(*(F.lit(n) for n in sorted(lengths))), lambda n: F.length("_path") >= n)
    grown = urls.where("_host <> ''").select("_url", "_path", F.explode(host_suffixes(F.col("_host"), sorted(labels))).alias("_suffix"), ends.alias("_ends"))
    grown = grown.select("_url", F.length("_suffix").alias("_hn"), F.explode("_ends").alias("_pn"), "_suffix", "_path")
    said = grown.withColumn("_digest", F.sha2(F.concat("_suffix", F.left("_path", F.col("_pn"))), 256))
    said = said.select("_url", "_hn", "_pn", "_digest", F.left("_digest", F.lit(PREFIX_HEX)).alias("short"))
    hits = said.join(broadcast_within(ready, MAX_BROADCAST_RULES), "short")
    hits = hits.where((F.col("_digest") == F.col("digest")) & (F.col("_hn") == F.col("rule_host")) & (F.col("_pn") == F.col("rule_path")))
    best = hits.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "block", "rule")).alias("_best"))
    out = join_hot(base, best, "_url", counts).withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url")))
    out = out.withColumn("rule", F.col("_best.rule"))
    verdict = F.when(F.col("_best").isNull(), default).when(F.col("_best.block"), "block").otherwise("allow")
    return out.withColumn("verdict", verdict).drop("_url", "_best")
