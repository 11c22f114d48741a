"""Two-level suffix scan of a trailer's time line."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quaysight.operators.trailers import slice_timeline, slices_ahead, task_spans
from tests.pair_forms import task_spans_range_join
from tests.test_plans import plan_of

SPANS = "trailer_id long, checkin_dttm timestamp_ntz"
TASKS = "trailer_id long, created_dttm timestamp_ntz, last_updated_dttm timestamp_ntz"
START = dt.datetime(2023, 11, 27)


def plain(spans, tasks):
    out = []
    for trailer, at in spans:
        met = [(c, u) for k, c, u in tasks if k == trailer and c is not None and c >= at]
        updates = [u for _, u in met if u is not None]
        out.append((trailer, at, min((c for c, _ in met), default=None), max(updates, default=None)))
    return out


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("bucket", "stretch", "minutes"), [("hour", "month", 60 * 24 * 120), ("minute", "hour", 300), ("day", "year", 60 * 24 * 900)])
def test_random_time_lines(spark, bucket, stretch, minutes):
    rnd = random.Random(minutes)

    def at():
        return START + dt.timedelta(minutes=rnd.randrange(minutes), seconds=rnd.choice([0, 0, 30]))

    tasks = [(rnd.choice([1, 2, 3, None]), rnd.choice([at(), at(), at(), None]), rnd.choice([at(), at(), None])) for _ in range(400)]
    tasks += tasks[:50]
    spans = list({(rnd.choice([1, 2, 3, 4]), at()) for _ in range(60)} | {(k, c) for k, c, _ in tasks[:40] if k and c})
    a, b = spark.createDataFrame(spans, SPANS), spark.createDataFrame(tasks, TASKS)
    got = key(map(tuple, task_spans(a, b, bucket, stretch).collect()))
    assert got == key(plain(spans, tasks))
    pairs = {tuple(r) for r in task_spans_range_join(a, b).collect()}
    assert pairs == {r for r in got if r[2] is not None}


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, START)], SPANS), spark.createDataFrame([(1, START, START)], TASKS)
    assert task_spans(a.limit(0), b).count() == 0
    assert [tuple(r) for r in task_spans(a, b.limit(0)).collect()] == [(1, START, None, None)]
    assert [tuple(r) for r in task_spans(a, b).collect()] == [(1, START, START, START)]


def hot(spark):
    """Half of all tasks and check-ins belong to trailer 1."""
    trailer = F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("long").alias("trailer_id")
    at = F.timestamp_add("MINUTE", (F.col("id") * 7) % (60 * 24 * 90), F.lit(START).cast("timestamp_ntz"))
    tasks = spark.range(60_000).select(trailer, at.alias("created_dttm"), F.timestamp_add("MINUTE", F.lit(5), at).alias("last_updated_dttm"))
    spans = spark.range(0, 60_000, 3).select(trailer, F.timestamp_add("MINUTE", F.lit(-3), at).alias("checkin_dttm")).distinct()
    return spans, tasks


def test_a_hot_trailer_is_spread_at_every_step(spark):
    spans, tasks = hot(spark)
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        timeline = slice_timeline(spans, tasks, "hour")
        plan = plan_of(timeline)
        assert all("_slice" in w or "created_dttm" in w or "checkin_dttm" in w for w in re.findall(r"hashpartitioning\(([^)]*)\)", plan)), plan
        per_task = [r["count"] for r in timeline.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(per_task) < 2 * sum(per_task) / 16
        slices = timeline.filter("_leads").select("trailer_id", "_slice", "_slice_min", "_slice_max")
        plan = plan_of(slices_ahead(slices, "month"))
        # a trailer comes together only as one row a range
        alone = re.findall(r"Exchange hashpartitioning\(trailer_id#\d+L?, \d+\)[^\n]*\n([^\n]*)", plan)
        assert len(alone) == 1 and "HashAggregate" in alone[0], plan
        spread = task_spans(spans, tasks)
        per_task = [r["count"] for r in spread.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(per_task) < 3 * sum(per_task) / 16
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
