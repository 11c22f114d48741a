"""Checked pivot and salted fan-out against one LEFT JOIN per tag."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaysight.operators import fanout
from quaysight.operators.eav import attach_attributes_by_joins, attach_attributes_checked
from quaysight.operators.notes import attach_notes_checked, tagged_notes
from tests.test_plans import plan_of

WANTED = {"one": "A", "two": "B", "three": "C"}


def tables(spark, base, tall):
    return (spark.createDataFrame(base, "k long, other string"),
            spark.createDataFrame(tall, "k long, tag string, value string"))


def plain(base, tall):
    out = Counter()
    for k, other in base:
        rows = [(k, other)]
        for tag in WANTED.values():
            found = [v for key, t, v in tall if key == k and k is not None and t == tag] or [None]
            rows = [(*r, v) for r in rows for v in found]
        out.update(rows)
    return out


def random_tall(rnd, keys, most):
    return [(rnd.choice([None, *range(keys)]), rnd.choice(["A", "B", "C", "D", None]), rnd.choice(["x", "y", "", None]))
            for _ in range(most)]


@pytest.mark.parametrize(("keys", "most", "salted"), [(200, 100, 10), (30, 120, 1_000_000), (12, 150, 8), (3, 60, 50)])
def test_same_rows_as_the_joins(spark, keys, most, salted):
    rnd = random.Random(keys)
    base = [(rnd.choice([None, *range(keys + 3)]), rnd.choice(["p", "q"])) for _ in range(40)]
    tall = random_tall(rnd, keys, most)
    b, t = tables(spark, base, tall)
    want = plain(base, tall)
    joins = fanout.attach_by_joins(b, t, "k", WANTED)
    checked = fanout.attach_checked(b, t, "k", WANTED, salted_rows=salted)
    assert joins.columns == checked.columns == ["k", "other", *WANTED]
    assert Counter(map(tuple, joins.collect())) == want
    assert Counter(map(tuple, checked.collect())) == want


@pytest.mark.parametrize("part", ["base", "tall", "both"])
def test_empty_tables(spark, part):
    b, t = tables(spark, [] if part in ("base", "both") else [(1, "p")], [] if part in ("tall", "both") else [(1, "A", "x"), (1, "A", "y")])
    want = {"base": 0, "both": 0, "tall": 1}[part]
    assert fanout.attach_checked(b, t, "k", WANTED).count() == want


def test_unique_tags_need_one_pass_and_no_lists(spark):
    b, t = tables(spark, [(1, "p"), (2, "q")], [(1, "A", "x"), (2, "A", None), (2, "B", "y")])
    pivot = plan_of(fanout.checked_pivot(t, "k", WANTED, 10))
    assert "ObjectHashAggregate" not in pivot and "collect_list" not in pivot
    plan = plan_of(fanout.attach_checked(b, t, "k", WANTED))
    assert "collect_list" not in plan and "Generate" not in plan and "Union" not in plan
    assert plan.count("Join") == 1


def test_only_repeated_keys_are_gathered(spark):
    b, t = tables(spark, [(1, "p"), (2, "q")], [(1, "A", "x"), (2, "A", "y"), (2, "A", "z")])
    plan = plan_of(fanout.attach_checked(b, t, "k", WANTED))
    lists = plan[plan.index("collect_list"):]
    assert "LeftSemi" in lists and "Union" not in plan   # the tall table is cut to the repeated keys


def test_a_hot_key_does_not_meet_in_one_task(spark):
    """2,000 values of two tags, 4 million rows of one key: salts spread them."""
    tall = spark.range(2000).selectExpr("7L AS k", "'A' AS tag", "concat('a', id) AS value").unionByName(
        spark.range(2000).selectExpr("7L AS k", "'B' AS tag", "concat('b', id) AS value")).unionByName(
        spark.range(50).selectExpr("id + 10 AS k", "'A' AS tag", "concat('c', id) AS value"))
    base = spark.range(60).selectExpr("id AS k", "'p' AS other")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = fanout.attach_checked(base, tall, "k", WANTED, salted_rows=50_000)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == 4_000_000 + 59
        assert max(per_task) < 0.35 * sum(per_task) and sum(n > 100_000 for n in per_task) >= 6
        facts = out.where("k = 7").agg(F.countDistinct("one", "two").alias("pairs"), F.count("three").alias("three")).first()
        assert (facts.pairs, facts.three) == (4_000_000, 0)
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_attributes_and_notes_use_it(spark):
    attrs = spark.createDataFrame([(1, "NUM_CNT", "a"), (1, "NUM_CNT", None), (1, "CUST_COMMENTS", "c"), (2, "NB_PALETTE", "3"), (3, "OTHER", "x")],
                                  "appointment_id long, attribute_name string, attribute_value string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "appointment_id long")
    a, b = (Counter(map(tuple, f(ids, attrs).collect())) for f in (attach_attributes_checked, attach_attributes_by_joins))
    assert a == b and sum(a.values()) == 5
    notes = spark.createDataFrame([(1, "#one"), (1, "#two"), (1, "$x"), (2, "#"), (3, None)], "shipment_id long, note string")
    ships = spark.createDataFrame([(1,), (2,), (3,)], "shipment_id long")
    tags = {"debord": "#", "users": "$"}
    tall = tagged_notes(notes).select("shipment_id", "tag", F.col("body").alias("value"))
    assert Counter(map(tuple, attach_notes_checked(ships, notes, tags, salted_rows=1).collect())) == \
        Counter(map(tuple, fanout.attach_by_joins(ships, tall, "shipment_id", tags).collect()))
