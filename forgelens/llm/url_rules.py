"""URL filters: nested host rules met by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, named, others, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to / ? # or the end, A-Z lower-cased;
    path: from there up to ? # or the end. Null, or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``: all hosts below a host start with its
    key, so they fill the interval from the key to the same with / for the last dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame, partitions: int) -> DataFrame:
    """The stack of intervals around each point. ``points(key)``; ``intervals(key, end, id)``
    are nested or apart, each from ``key`` (inclusive) to ``end`` (exclusive). Returns key,
    slot, id: one row for each interval that is open at the point; slot 1 is the outermost.

    Starts, ends and points are sorted once, by ranges of their keys. A start pushes, an end
    pops: the running sum of both is the stack's height, and what lies in a slot is the
    interval pushed last at that height. A range takes over the heights and slots of the
    ranges before it, of which there is a row for each range and slot. Ends come before
    starts, starts before points.
    """
    no_id = F.lit(None).cast(dict(intervals.dtypes)["id"])
    events = (
        intervals.select("key", F.lit(1).alias("kind"), F.lit(1).alias("step"), "id")
        .unionByName(intervals.select(F.col("end").alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), no_id.alias("id")))
        .unionByName(points.select("key", F.lit(2).alias("kind"), F.lit(0).alias("step"), no_id.alias("id")))
    )
    placed = staged(events.repartitionByRange(partitions, "key", "kind").withColumn("range", F.spark_partition_id()), "sweep")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.sum("step").alias("sum")).select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    # Of starts with one key the outer one, which ends last, is pushed first: one interval has one key.
    running = F.sum("step").over(Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    heights = placed.withColumn("height", running).join(F.broadcast(sums), "range").withColumn("height", F.col("height") + F.col("base"))
    heights = staged(heights.where("kind > 0 AND height > 0").drop("step", "base"), "heights")
    slots = heights.select("range", "key", "kind", "id", F.explode(F.when(F.col("kind") == 1, F.array("height")).otherwise(F.sequence(F.lit(1).cast("long"), "height"))).alias("slot"))
    pushed = heights.where("kind = 1").groupBy("range", F.col("height").alias("slot")).agg(F.max_by("id", "key").alias("id"))
    before = pushed.select("range", "slot", F.lead("range").over(Window.partitionBy("slot").orderBy("range")).alias("until"), "id")
    inside = F.last("id", ignorenulls=True).over(Window.partitionBy("range", "slot").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = slots.withColumn("id", inside).where("kind = 2")
    known, open_ = found.where("id IS NOT NULL"), found.where("id IS NULL").drop("id")
    carried = before.select("slot", "id", F.explode(F.sequence(F.col("range") + 1, F.coalesce("until", F.lit(partitions)))).alias("range"))
    return known.select("key", "slot", "id").unionByName(open_.join(carried, ["range", "slot"]).select("key", "slot", "id"))


def _host_intervals(rules: DataFrame) -> DataFrame:
    """One interval for each host that has rules: all hosts below it."""
    key = host_key(F.col("host")).alias("key")
    return rules.select(F.col("host").alias("id"), key).distinct().select("key", F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("end"), "id")


def _path_key(host: Column, path: Column) -> Column:
    """Host and path as bytes of UTF-8, of which none is 255: so a prefix's interval ends
    with that one after it."""
    return F.concat(host, F.lit("\u0000"), path).cast("binary")


def longest_rules(pages: DataFrame, rules: DataFrame, partitions: int) -> DataFrame:
    """host, path, best for distinct ``pages(host, path)`` that a rule fits: a struct length,
    host_length, rule, verdict of the longest one.

    A first sweep gives each host the rule hosts around it. A second one, over rule host and
    path, gives each path the rule paths of that host that it begins with, of which the top
    of the stack is the longest. So a host's rules are never looked through one by one.
    """
    hosts = pages.select("host").distinct().select(host_key(F.col("host")).alias("key"), "host")
    around = sweep(hosts.select("key"), _host_intervals(rules), partitions)
    above = hosts.join(around, "key").select("host", F.col("id").alias("rule_host"))
    asked = staged(pages.join(above, "host").select("host", "path", "rule_host", _path_key(F.col("rule_host"), F.col("path")).alias("key")), "asked")
    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    start = _path_key(F.col("host"), F.col("path"))
    spans = own.select(start.alias("key"), F.concat(start, F.lit(b"\xff")).alias("end"), F.struct("path", "verdict").alias("id"))
    fit = sweep(asked.select("key").distinct(), spans, partitions).groupBy("key").agg(F.max_by("id", "slot").alias("top"))
    length = (F.length("rule_host") + F.length("top.path")).alias("length")
    best = F.struct(length, F.length("rule_host").alias("host_length"), F.concat("rule_host", "top.path").alias("rule"), F.col("top.verdict").alias("verdict"))
    return asked.join(fit, "key").groupBy("host", "path").agg(F.max(best).alias("best"))


def judge(pages: DataFrame, rules: DataFrame, partitions: int, url: str = "url", default: str = "allow", no_host: str = "block") -> DataFrame:
    """``pages`` with host, path, rule, verdict. ``rules(verdict, host, path)``: a rule fits
    its host and all subdomains if the page's path starts with the rule's; the longest
    (host and path together, then host, then the verdict block) wins. Where none fits, rule
    is null and the verdict is ``default``, or ``no_host`` for pages whose url has no host.

    Null urls have no host; rules without host or path are ignored. Each distinct host and
    path is swept once, however many pages it has; the pages meet what was found in a join
    whose large partitions Spark can split. Repeated rows stay; columns of pages with one of
    the new names, in whatever case, are replaced; no rules, or no pages, are fine.
    """
    host, path = url_parts(named(url))
    kept = others(pages, "host", "path", "rule", "verdict")
    h, p = fresh(pages, "page_host", "page_path")
    parts = pages.select(*kept, host.alias(h), path.alias(p))
    found = longest_rules(parts.where(named(h) != "").select(named(h).alias("host"), named(p).alias("path")).distinct(), rules.where("host IS NOT NULL AND path IS NOT NULL"), partitions)
    fh, fp, best = fresh(parts, "found_host", "found_path", "best")
    found = found.select(F.col("host").alias(fh), F.col("path").alias(fp), F.col("best").alias(best))
    met = parts.join(found, (named(h) == named(fh)) & (named(p) == named(fp)), "left")
    verdict = F.coalesce(named(best)["verdict"], F.when(named(h) == "", F.lit(no_host)).otherwise(F.lit(default)))
    return met.select(*kept, named(h).alias("host"), named(p).alias("path"), named(best)["rule"].alias("rule"), verdict.alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in RULES])
    rules = spark.range(1).select(F.inline(rows))
    return judge(pages, rules, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
      FROM p LEFT JOIN r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE n = 1
"""
