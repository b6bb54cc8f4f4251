"""URL rules by a sort-merge range join, in DataFrame functions only.

A url's key is its host's labels in reverse order, each closed by a dot, then a
slash and the path: ``com.example.www./en/1``. A rule for a host holds for the
host and all its subdomains when the path starts with the rule's path. With the
path in front of the deeper labels no single interval would do, so a rule covers,
for each url, one of the url's *views*: the reversed host cut after each label,
followed by the path. In views a rule is exactly the interval of keys that start
with its own key, and intervals are either nested or disjoint.

Rules become two events each, begin and end of their interval; views and events
are sorted together and a running fold over the sorted rows carries the stack of
open rules, whose top is the longest rule that covers a view. Rows are dealt over
buckets by a hash of the url so that one host, or one url, spreads over all
buckets; every bucket gets all rules, whose number is checked. A url's verdict is
that of its view with the longest rule.

Defined results: null urls, and urls without ``://``, have empty host and path
and match no rule; repeated rules count once (allow wins a tie); repeated rows
are judged one by one; empty tables give an empty result or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Sorts after whatever may follow a key.
AFTER_ALL = "\U0010ffff"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def rule_stack(rules: DataFrame) -> DataFrame:
    """One row of all rules: an array of the begin and end events of their
    intervals, each with the rule on top of the stack after it."""
    keyed = rules.select(
        F.concat(reversed_host(F.split(F.coalesce("host", F.lit("")), "[.]")), F.coalesce("path", F.lit(""))).alias("key"),
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"),
        F.col("verdict"),
    )
    once = keyed.groupBy("key", "rule").agg(F.min("verdict").alias("verdict"))  # allow wins
    listed = once.agg(F.array_sort(F.collect_list(F.struct("key", "rule", "verdict"))).alias("rules"))
    none = "array<struct<key:string,rule:string,verdict:string>>"
    events = "array<struct<key:string,ends:boolean,top:struct<key:string,rule:string,verdict:string>>>"
    fold = F.aggregate(
        "rules",
        F.struct(F.array().cast(none).alias("stack"), F.array().cast(events).alias("events")),
        _push,
    )
    return listed.select(fold["events"].alias("events"))


def _push(a: Column, r: Column) -> Column:
    # the rules that are open at r are those whose keys begin r's key
    opened = F.filter(a["stack"], lambda s: F.startswith(r["key"], s["key"]))
    parent = F.try_element_at(opened, F.lit(-1))
    begin = F.struct(r["key"].alias("key"), F.lit(False).alias("ends"), r.alias("top"))
    end = F.struct(F.concat(r["key"], F.lit(AFTER_ALL)).alias("key"), F.lit(True).alias("ends"), parent.alias("top"))
    return F.struct(F.concat(opened, F.array(r)).alias("stack"), F.concat(a["events"], F.array(begin, end)).alias("events"))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 5000) -> DataFrame:
    """One row per url: the id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: host, path, verdict (allow or block). They are counted first; past
    ``max_rules`` they are swept in blocks and the longest rule over the blocks
    wins, so that a bucket never holds more than one block.
    """
    spark = pages.sparkSession
    many = rules.count()
    blocks = max(1, -(-many // max_rules))
    depths = sorted(r[0] for r in rules.select(F.size(F.split(F.coalesce("host", F.lit("")), "[.]"))).distinct().collect())
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    if blocks > 1:  # rows keep their numbers over all passes
        urls = saved(urls, "urls")
    labels = F.split("host", "[.]")
    views = [F.when((F.size(labels) >= d) & (F.col("host") != ""), F.concat(reversed_host(F.slice(labels, F.size(labels) - d + 1, F.lit(d))), F.col("path"))) for d in depths]
    covered = F.filter(F.array(F.lit(None).cast("string"), *views), lambda v: v.isNotNull())
    points = urls.withColumn("key", F.explode_outer(covered))
    points = points.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    top_type = "struct<key:string,rule:string,verdict:string>"
    best = None
    for b in range(blocks):
        part = rules if blocks == 1 else rules.filter(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == b)
        events = rule_stack(part).select(F.explode("events").alias("e"), F.sequence(F.lit(0), F.lit(buckets - 1)).alias("all")).select(
            F.explode("all").alias("_bucket"), F.col("e.key").alias("key"), F.when(F.col("e.ends"), 0).otherwise(1).alias("_turn"), F.coalesce("e.top", F.struct(*[F.lit(None).cast("string").alias(c) for c in ("key", "rule", "verdict")])).alias("_top")
        )
        sorted_rows = points.withColumn("_turn", F.lit(2)).withColumn("_top", F.lit(None).cast(top_type)).unionByName(events, allowMissingColumns=True)
        sweep = Window.partitionBy("_bucket").orderBy("key", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        swept = sorted_rows.withColumn("_open", F.last("_top", ignorenulls=True).over(sweep)).filter("_turn = 2")
        longest = F.max(F.when(F.col("_open.rule").isNotNull() & F.col("key").isNotNull(), F.struct(F.length("_open.rule").alias("n"), F.col("_open.rule").alias("rule"), F.col("_open.verdict").alias("verdict"))))
        found = swept.groupBy("_bucket", "_row").agg(F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"), longest.alias("best"))
        best = found if best is None else best.unionByName(found)
    if blocks > 1:
        best = best.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

