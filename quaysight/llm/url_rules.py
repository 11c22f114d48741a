"""URL filter rules by a sort-merge range join, in DataFrame functions only.

The labels of a host, reversed and each ended by a dot, make a key under which
a host and all its subdomains are one interval: ``com.example.`` up to
``com.example/``.  Rule hosts give a start and an end event; pages are points.
Events and points are sorted together, over range partitions, and swept: every
event carries the stack of the rules that are active from it on (nested rules
of the host and of the hosts above it), and a point takes the stack of the
last event before it.  Of the stack the longest rule whose path starts the
page's path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaysight.llm.common import stored

DEFAULT_VERDICT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _above(key: Column) -> Column:
    """Keys of the host itself and of every host above it."""
    labels = F.split(F.regexp_replace(key, r"\.$", ""), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))


def rule_events(rules: DataFrame) -> DataFrame:
    """``rules(verdict, host, path)`` -> ``(at, stack)``: from ``at`` on the
    rules of ``stack`` are active, the longest first.  Of two verdicts for one
    host and path ``block`` holds."""
    own = (rules.where("host IS NOT NULL AND host <> ''")
           .select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
           .select(host_key(F.col("host")).alias("node"),
                   F.struct((-F.length(F.concat("host", "path"))).alias("less"), (-F.length("host")).alias("less_host"),
                            F.concat("host", "path").alias("rule"), "path", "verdict").alias("r")))
    nodes = own.select("node").distinct()
    lines = nodes.select("node", F.explode(_above(F.col("node"))).alias("up"))
    active = (lines.join(own.withColumnRenamed("node", "up"), "up").groupBy("node")
              .agg(F.array_sort(F.collect_list("r")).alias("stack")))
    parent = (lines.where("up <> node").join(nodes.withColumnRenamed("node", "up"), "up")
              .groupBy("node").agg(F.max("up").alias("parent")))
    ends = (nodes.join(parent, "node", "left")
            .join(active.select(F.col("node").alias("parent"), "stack"), "parent", "left")
            .select(F.concat(F.expr("substring(node, 1, length(node) - 1)"), F.lit("/")).alias("at"), "stack"))
    kind = active.schema["stack"].dataType
    return active.select(F.col("node").alias("at"), "stack").union(
        ends.select("at", F.coalesce("stack", F.array().cast(kind)).alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    A rule fits its host and all subdomains if the page's path starts with the
    rule's; the longest rule (host and path together; then the longer host)
    wins, and without one the verdict is ``default``.  Null urls and those
    without ``://`` have empty host and path and fit no rule.  Null ids and
    repeated rows are judged like any; rules without a host fit nothing; empty
    tables give no rows, or the default for all.  Other columns are ignored.
    """
    events = stored(rule_events(rules), "rule-events")
    url = F.col(url_col).cast("string")
    points = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).select(
        host_key(F.col("host")).alias("at"), F.lit(1).alias("kind"), F.xxhash64("page_id", "path").alias("tie"),
        "page_id", "host", "path", F.lit(None).cast(events.schema["stack"].dataType).alias("stack"))
    marks = events.select(
        "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"),
        F.lit(None).cast(points.schema["page_id"].dataType).alias("page_id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    # the tie spreads a host that holds many pages over several ranges
    swept = stored(points.union(marks).repartitionByRange("at", "kind", "tie")
                   .withColumn("part", F.spark_partition_id()), "swept")
    # what is active when a range begins: the last event of the ranges before it
    last = swept.where("kind = 0").groupBy("part").agg(F.max_by("stack", "at").alias("stack"))
    parts = swept.groupBy("part").agg(F.lit(1).alias("one")).join(last, "part", "left")
    carried = parts.select("part", F.last("stack", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    running = Window.partitionBy("part").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per range: bounded by the number of shuffle partitions
    active = (swept.withColumn("stack", F.last("stack", ignorenulls=True).over(running)).where("kind = 1")
              .join(F.broadcast(carried), "part", "left"))
    fits = F.filter(F.coalesce("stack", "carried"), lambda r: F.startswith(F.col("path"), r["path"]))
    won = F.when(F.col("host") != "", F.get(fits, F.lit(0)))
    return active.select("page_id", "host", "path", won.alias("won")).select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
