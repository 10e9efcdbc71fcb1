"""URL filters by a sort-merge range join.

A host's labels are reversed, so that a rule's subdomains are one interval of keys: ``net.example.`` up to
``net.example/``, as ``/`` follows ``.``. Rules and urls are dealt into ranges of the sorted keys and each range is
swept in order. Rule intervals nest or are apart, so the stack of rules active at a url is the chain of the rule that
started last, less those that have ended. The longest rule of the stack whose path begins the url's path decides.

Ranges are bounded by quantiles of a sample of keys that end in a hash of the url's path and id, so a host with a third
of all urls is spread over as many ranges as it needs, however alike its paths are. A rule that spans several ranges
enters each of them. Everything is DataFrame operations.

Rows: a null url, or one without ``://``, has an empty host and path, no rule, and the default verdict. Rows that
repeat an id are judged one by one. Of equally long rules the one with the longer host wins, then a block, then the
one that sorts first; rules with a null host or path are left out. Other columns of the pages are not read. Urls of any
length are read whole. An empty table gives no rows, and without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.common import table

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Ranges for each shuffle partition, and keys sampled for each range.
RANGES_EACH, SAMPLED_EACH = 8, 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOW), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_chains(rules: DataFrame) -> DataFrame:
    """(lo, hi, chain) for each host with rules: all rules of the host and its parents, the best first."""
    said = rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOW).alias("host"), "path", "action")
    nodes = said.groupBy("host", "path").agg(F.max("action").alias("action"))
    one = F.struct(
        (-F.length("host") - F.length("path")).alias("size"), (-F.length("host")).alias("host_size"), F.when(F.col("action") == "block", 0).otherwise(1).alias("tie"),
        F.concat("host", "path").alias("rule"), "path", "action", F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("hi"),
    )
    nodes = nodes.withColumn("key", reversed_host(F.col("host"))).groupBy("key").agg(F.collect_list(one).alias("rules"))
    labels = F.split("key", r"\.", -1)
    parents = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("parent"))
    chained = parents.join(nodes.withColumnRenamed("key", "parent"), "parent").groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("chain"))
    return chained.select(F.col("key").alias("lo"), F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("hi"), "chain")


def ranges(keyed: DataFrame) -> list[str]:
    """Ascending bounds of the key ranges, from a sample whose size follows the number of ranges, not the table's."""
    want = RANGES_EACH * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, want * SAMPLED_EACH / max(1, keyed.count()))
    part = F.pmod(F.xxhash64(F.lit("ranges"), "key"), F.lit(1 << 30)) < int(share * (1 << 30))
    found = sorted((r["k"] for r in keyed.where(part).select(F.col("key").alias("k")).collect()), key=lambda k: k.encode())
    return list(dict.fromkeys(found[i * len(found) // want] for i in range(1, want))) if found else []


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds the key has reached; found in two steps, so a row costs about two square roots of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b <= key))
    inner = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    return F.when(outer == 0, 0).otherwise((outer - 1) * step + F.size(F.filter(F.element_at(inner, F.greatest(outer, F.lit(1))), lambda b: b <= key)))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages: (page_id, url); rules: (host, path, action). Returns (page_id, host, path, rule, verdict)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    # rules are intervals of hosts, so urls of a host may come in any order
    keyed = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("\0"), F.hex(F.xxhash64("path", "page_id"))))
    bounds = ranges(keyed)
    chains = rule_chains(rules)
    started = chains.select(F.explode(F.sequence(range_of(F.col("lo"), bounds), range_of(F.col("hi"), bounds))).alias("part"), F.col("lo").alias("key"), "chain")
    swept = keyed.withColumn("part", range_of(F.col("key"), bounds)).withColumn("is_url", F.lit(True)).unionByName(started, allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = swept.withColumn("stack", F.last("chain", ignorenulls=True).over(order)).where("is_url")
    fits = F.filter("stack", lambda r: (r["hi"] > F.col("key")) & F.startswith(F.col("path"), r["path"]))
    return stack.withColumn("best", F.try_element_at(fits, F.lit(1))).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM (
  SELECT u.page_id, u.host, u.path,
    (SELECT struct_pack(rule := r.host || r.path, action := r.action) FROM rules r
     WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
     ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.action DESC, r.host LIMIT 1) AS best
  FROM urls u)
"""
