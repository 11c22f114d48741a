"""Literal cases (FIXTURES.md §5): expected constants, no engine as judge.

These cover the traps where Spark and DuckDB both deviate from the source
dialect the same way, so an oracle comparison alone would not catch them.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaysight.functions import (
    business_day_window,
    minutes_of_day_since,
    minutes_since,
    ora_concat,
    ora_substr,
    proper_name,
    round_share,
    share_string,
    to_integer,
    trunc_ratio_pct,
)
from quaysight.operators.appointments import dock_pole, eligibility
from quaysight.operators.notes import po_priority, tagged_notes
from quaysight.operators.shipments import door_code, id_split, location_code


def one(spark, expr, schema="x string", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr.alias("out")).collect()]


def test_id_split(spark):
    df = spark.createDataFrame([("CH00000042",), ("97",), ("ABCDE",), (None,)], "tc_shipment_id string")
    left, right = id_split("tc_shipment_id")
    got = [tuple(r) for r in df.select(left, right).collect()]
    assert got == [("CH000", "00042"), (None, None), (None, "ABCDE"), (None, None)]


def test_substr_rules(spark):
    rows = [("abc",), ("A",), ("",), (None,)]
    assert one(spark, ora_substr(F.col("x"), -5), rows=rows) == [None, None, None, None]
    assert one(spark, ora_substr(F.col("x"), -2, 2), rows=rows) == ["bc", None, None, None]
    assert one(spark, ora_substr(F.col("x"), 2, 0), rows=rows) == [None, None, None, None]
    assert one(spark, ora_substr(F.col("x"), 0, 2), rows=rows) == ["ab", "A", None, None]
    assert one(spark, ora_substr(F.col("x"), 2, 499), rows=[("#",), ("#abc",)]) == [None, "abc"]


def test_concat_null_tolerant(spark):
    df = spark.createDataFrame([("a", None), (None, None), (None, "b"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(ora_concat("a", "b")).collect()] == ["a", None, "b", None]


def test_door_and_location_codes(spark):
    assert one(spark, door_code(F.col("x")), rows=[("Q007",), ("A",)]) == ["Q07", "A"]
    df = spark.createDataFrame([("A12", "03"), ("A12", None)], "aisle string, lvl string")
    assert [r[0] for r in df.select(location_code(F.col("aisle"), F.col("lvl"))).collect()] == ["203", "2"]


def test_note_tags(spark):
    df = spark.createDataFrame([(1, "#abc"), (2, "#"), (3, None)], "shipment_id long, note string")
    got = [tuple(r) for r in tagged_notes(df).orderBy("shipment_id").select("tag", "body").collect()]
    assert got == [("#", "abc"), ("#", None), (None, None)]


def test_proper_name(spark):
    rows = [("jean-paul dupont",), (None,), ("a",), ("x" * 60,)]
    assert one(spark, proper_name("x"), rows=rows) == ["Jean-paul dupont", None, "A", "X" + "x" * 50]


def test_shares(spark):
    df = spark.createDataFrame([(5, 8), (1, 8), (4, 8), (3, 8), (0, 0)], "p long, n long")
    assert [r[0] for r in df.select(round_share("p", "n")).collect()] == [63, 13, 50, 38, None]
    df = spark.createDataFrame([(63, 25, 12), (100, 0, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(share_string("a", "b", "c")).collect()] == ["063 / 025 / 012", "100 / 000 / 000"]


def test_truncated_ratio_is_exact(spark):
    df = spark.createDataFrame([(29, 100), (1, 3), (0, 0), (57, 100), (2, 3)], "a long, b long")
    assert [r[0] for r in df.select(trunc_ratio_pct("a", "b")).collect()] == [29, 33, None, 57, 66]
    # every pair a <= b <= 100 agrees with exact rational truncation
    pairs = spark.range(1, 101).select(F.col("id").alias("b")).crossJoin(
        spark.range(0, 101).select(F.col("id").alias("a"))).filter("a <= b")
    bad = pairs.filter(trunc_ratio_pct("a", "b") != F.expr("(a * 100) div b")).count()
    assert bad == 0


def test_minutes(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 4, 14, 15, 1, 30),)], "t timestamp_ntz")
    as_of = "2022-04-16 17:05:00"
    assert df.select(minutes_of_day_since(as_of, "t")).first()[0] == 123
    assert df.select(minutes_since(as_of, "t")).first()[0] == 3004
    late = spark.createDataFrame([(dt.datetime(2022, 4, 16, 19, 35, 0),)], "t timestamp_ntz")
    assert late.select(minutes_of_day_since(as_of, "t")).first()[0] == -150
    half = spark.createDataFrame([(dt.datetime(2022, 4, 16, 17, 2, 30, 900000),)], "t timestamp_ntz")
    assert half.select(minutes_since(as_of, "t")).first()[0] == 3   # 150 s -> 2.5 -> 3


def test_to_integer(spark):
    rows = [("12.6",), (None,), ("12.5",), ("7",)]
    assert [None if v is None else int(v) for v in one(spark, to_integer("x"), rows=rows)] == [13, None, 13, 7]
    with pytest.raises(Exception):
        spark.createDataFrame([("x",)], "x string").select(to_integer("x")).collect()
    assert spark.createDataFrame([("x",)], "x string").select(to_integer("x", strict=False)).first()[0] is None


@pytest.mark.parametrize("as_of,last_day", [
    ("2022-04-15 10:00:00", dt.date(2022, 4, 18)),   # Friday -> Monday
    ("2022-04-14 10:00:00", dt.date(2022, 4, 15)),   # Thursday -> Friday
])
def test_business_day_window(spark, as_of, last_day):
    first = dt.date.fromisoformat(as_of[:10])
    days = spark.range(-2, 8).select(
        F.timestamp_add("DAY", F.col("id"), F.lit(f"{as_of[:10]} 23:59:00").cast("timestamp_ntz")).alias("t"))
    kept = sorted(r[0].date() for r in days.filter(business_day_window("t", as_of)).collect())
    expected = [first + dt.timedelta(days=i) for i in range((last_day - first).days + 1)]
    assert kept == expected


def test_po_priority(spark):
    rows = [("PUx",), ("CU",), ("WU",), ("P0",), ("C0",), ("W0",), ("UR",), ("ZZ",), (None,), ("P",)]
    assert one(spark, po_priority(F.col("x")), rows=rows) == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8]


def test_dock_pole_unfiltered(spark):
    rows = [("BATIMENT A",), ("RDV LOL",), ("BATIMENT C1",), ("AUTRE",), (None,)]
    assert one(spark, dock_pole(F.col("x")), rows=rows) == ["POLE_AB", "POLE_AB", "POLE_C", "TO_DEFINE", "TO_DEFINE"]


def test_eligibility_case(spark):
    schema = "r string, c string, d string, pal string, pack string, n long"
    rows = [
        ("G1", None, "BATIMENT A", "1", None, 1),          # excluded prefix
        (None, "C1", "BATIMENT A", "1", None, 1),          # closed list prefix counts (NULL-tolerant ||)
        ("31", None, "RDV LOL", "1", None, 1),             # excluded slot
        ("31", None, "BATIMENT A", None, None, None),      # prefix 3 -> shown
        (None, None, "BATIMENT B", "12.6", None, None),    # quantity -> shown
        (None, None, "BATIMENT B", "0", "0", 0),           # nothing -> hidden
        (None, None, None, "5", None, None),               # no slot -> hidden
        (None, None, "BATIMENT A (CONTAINER)", "5", None, None),  # slot not listed
    ]
    df = spark.createDataFrame(rows, schema)
    e = eligibility(F.col("r"), F.col("c"), F.col("d"), F.col("pal"), F.col("pack"), F.col("n"))
    assert [r[0] for r in df.select(e).collect()] == [0, 0, 0, 1, 1, 0, 0, 0]


def test_dock_order_nulls_like_source(spark):
    """ORDER BY door ASC (NULLs last), stop DESC (NULLs first)."""
    from quaysight.plans.dock_doors import DOCK_COLUMNS, _finish

    rows = [("Q002", 3), (None, 5), ("Q001", None), ("Q001", 2), ("Q001", 4), (None, None)]
    df = spark.createDataFrame(rows, "porte_de_quai string, arret int")
    for c in DOCK_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    got = [(r.porte_de_quai, r.arret) for r in _finish(df, ordered=True).collect()]
    assert got == [("Q001", None), ("Q001", 4), ("Q001", 2), ("Q002", 3), (None, None), (None, 5)]


def test_as_of_accepts_column_and_datetime(spark):
    """The clock may be a string, a datetime or a Column (e.g. a live
    timestamp); the window is the same."""
    days = spark.range(0, 10).select(
        F.timestamp_add("HOUR", F.col("id") * 11, F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")).alias("t"))
    as_str = sorted(r[0] for r in days.filter(business_day_window("t", "2024-01-12 12:00:00")).collect())
    as_dt = sorted(r[0] for r in days.filter(business_day_window("t", dt.datetime(2024, 1, 12, 12))).collect())
    as_col = sorted(r[0] for r in days.filter(
        business_day_window("t", F.lit("2024-01-12 12:00:00").cast("timestamp_ntz"))).collect())
    assert as_str == as_dt == as_col and as_str
