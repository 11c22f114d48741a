"""Ordered lists in parts against the plain aggregate."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaysight.operators.lists import grouped_lists, hot_groups, lists_in_parts, ordered_list
from quaysight.operators.purchase import ROLLUP_KEYS, appointment_po_rollup, po_lists
from tests.test_plans import plan_of

KEYS = ["a", "b"]


def values(rnd, n):
    """A third of the rows in one group; NULL keys and values, ties, odd letters."""
    words = ["", "A", "a", "é", "Z9", "10", "9", "\U0001F600", "￿", "x y", None, *[f"P{i:04d}" for i in range(300)]]
    return [((1, "h") if rnd.random() < 0.34 else (rnd.choice([None, 1, 2, 3]), rnd.choice([None, "p"])))
            + (rnd.choice(words), rnd.choice(words), rnd.randrange(9)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a int, b string, x string, y string, n int").repartition(5)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def short(df, sep=" "):
    return df.groupBy(*KEYS).agg(ordered_list("x", sep).alias("lx"), ordered_list("y", sep).alias("ly"), F.sum("n").alias("s"))


@pytest.mark.parametrize(("n", "limit", "sep"), [(2000, 100, " "), (2000, 1, ", "), (300, 1000, " ")])
def test_hot_groups_give_equal_strings(spark, n, limit, sep):
    df = frame(spark, values(random.Random(n + limit), n))
    hot = hot_groups(df, KEYS, limit)
    assert (hot is None) == (n <= limit)
    if hot is not None:
        assert (1, "h") in {tuple(r) for r in hot.collect()}
    got = grouped_lists(df, KEYS, {"lx": "x", "ly": "y"}, [F.sum("n").alias("s")], hot, sep)
    assert got.columns == [*KEYS, "lx", "ly", "s"]
    assert rows_of(got) == rows_of(short(df, sep))


def test_groups_without_values_stay(spark):
    df = frame(spark, [(1, None, None, "v", 1), (1, None, None, None, 2), (2, "p", None, None, 3)])
    hot = df.select(*KEYS).distinct()
    got = rows_of(grouped_lists(df, KEYS, {"lx": "x", "ly": "y"}, [F.sum("n").alias("s")], hot))
    assert got == Counter([(1, None, None, "v", 3), (2, "p", None, None, 3)])


def test_one_group_of_all_rows(spark):
    df = frame(spark, values(random.Random(3), 3000))
    want = df.agg(ordered_list("x").alias("l")).first().l
    assert [r.l for r in lists_in_parts(df, [], "x", "l").collect()] == [want]
    assert [r.l for r in lists_in_parts(df.limit(0), [], "x", "l").collect()] == [None]
    same = spark.range(5000).selectExpr("'tie' AS x").repartition(4)
    assert lists_in_parts(same, [], "x", "l").first().l == " ".join(["tie"] * 5000)


def test_a_hot_group_is_listed_over_many_tasks(spark):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for value in (F.concat(F.lit("P"), F.col("id")), F.concat(F.lit("tie"), F.col("id") % 1)):   # also when all values are equal
            df = spark.range(40_000).select((F.col("id") % 1).alias("a"), F.concat(F.lit("h"), F.col("id") % 1).alias("b"), value.alias("x")).repartition(4)
            plan = plan_of(lists_in_parts(df, KEYS, "x", "l"))
            assert re.search(r"rangepartitioning\(a#\d+L? ASC NULLS FIRST, b#\d+ ASC NULLS FIRST, _value#\d+ ASC", plan)
            exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
            assert len(exchanges) == 2 and "_part" in exchanges[1] and "_part" not in exchanges[0]   # strings of parts, then one join
            dealt = df.withColumnRenamed("x", "_value").withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())) \
                .repartitionByRange(*KEYS, "_value", "_tie")
            per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert len(per_task) == 16 and max(per_task) < 3 * 40_000 / 16
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_po_rollup_of_a_hot_appointment(spark):
    rnd = random.Random(8)
    split = spark.createDataFrame(
        [(1 if rnd.random() < 0.4 else rnd.choice([2, 3, None]), rnd.choice([40, 30]), *rnd.choice([(f"3{rnd.randrange(99):07d}", None), (None, "G1"), (None, None)]),
          rnd.choice([5, 6, None]), rnd.randrange(1, 9), rnd.randrange(1, 5)) for _ in range(600)],
        "appointment_id long, appt_obj_type int, purchase_orders_running string, purchase_orders_closed string, "
        "business_partner_id long, purchase_orders_priority int, nb_lines long")
    hot = hot_groups(split, ROLLUP_KEYS, 50)
    assert hot is not None
    for fn in (appointment_po_rollup, po_lists):
        assert fn(split, hot).columns == fn(split).columns
        assert rows_of(fn(split, hot)) == rows_of(fn(split))
