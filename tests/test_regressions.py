"""Regression cases from the dated change notes of the source queries
"""

import datetime as dt

from pyspark.sql import functions as F

from quaysight.operators.extremes import load_first_last
from quaysight.operators.shipments import active_shipments, shipments_with_order_type

D = dt.datetime


def test_order_spread_over_shipments_finds_all(spark):
    """An order whose pieces sit on several shipments reaches each of them
    (the order row itself carries no single shipment; the join goes through
    the pieces)."""
    lpn = spark.createDataFrame([(1, 100, 10), (2, 100, 11), (3, 200, 12), (4, 100, None)],
                                "lpn_id long, order_id long, shipment_id long")
    orders = spark.createDataFrame([(100, "10"), (200, "20")], "order_id long, do_type string")
    got = sorted(r[0] for r in shipments_with_order_type(lpn, orders).collect())
    assert got == [10, 11]


def test_several_loaders_do_not_duplicate_rows(spark):
    """Users whose names differ only in case give one proper-cased loader."""
    users = spark.createDataFrame([("U1", "alice"), ("U2", "ALICE"), ("U3", "bob")],
                                  "user_name string, user_first_name string")
    trkg = spark.createDataFrame([
        ("S1", "RF CHARGER OLPN", D(2024, 1, 1, 8), "U3", 1),
        ("S1", "RF CHARGER OLPN", D(2024, 1, 1, 9), "U1", 2),
        ("S1", "RF CHARGER OLPN", D(2024, 1, 1, 9), "U2", 3),
        ("S1", "RF CHARGER OLPN", D(2024, 1, 1, 9), "U2", 4),
    ], "ref_field_1 string, menu_optn_name string, create_date_time timestamp_ntz, user_id string, seq_nbr long")
    got = [tuple(r) for r in load_first_last(trkg, users).collect()]
    assert got == [("S1", D(2024, 1, 1, 8), "Alice")]


def test_open_window_has_no_upper_bound(spark):
    """Shipments picked up after a long weekend or holidays stay listed."""
    ships = spark.createDataFrame([
        (1, 50, D(2001, 7, 16, 23, 0)),   # TRUNC = as_of - 4: out
        (2, 50, D(2001, 7, 17, 0, 0)),    # as_of - 3: in
        (3, 50, D(2001, 8, 30, 8, 0)),    # far ahead: in
        (4, 80, D(2001, 7, 21, 8, 0)),    # status out of band
        (5, None, D(2001, 7, 21, 8, 0)),  # NULL status
    ], "shipment_id long, shipment_status int, pickup_start_dttm timestamp_ntz")
    got = sorted(r[0] for r in active_shipments(ships, "2001-07-20 12:00:00").collect())
    assert got == [2, 3]


def test_stage_thresholds_depend_on_location_class(spark):
    """Status 20..30 is prepared in an R/P/unknown location, staged in S,
    and in no stage elsewhere; the dock variant counts only R as prepared."""
    from quaysight.operators.stages import ACTIVITY_RULE, DOCK_RULE, stage_flags

    df = spark.createDataFrame([(25, "R"), (25, "P"), (25, None), (25, "S"), (25, "X"), (10, "X"), (50, None),
                                (90, None)], "s int, c string")
    act = [tuple(r) for r in df.select(*stage_flags(F.col("s"), F.col("c"), ACTIVITY_RULE).values()).collect()]
    dock = [tuple(r) for r in df.select(*stage_flags(F.col("s"), F.col("c"), DOCK_RULE).values()).collect()]
    assert act == [(1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 1)]
    assert dock == [(1, 0, 0), (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_sql_views_and_job(spark, tmp_path):
    """The reports through spark.sql views, and the batch job writing one."""
    from quaysight.jobs import main
    from quaysight.plans.views import register_views
    from quaysight.sources import Wms
    from tests.conftest import SMALL

    names = register_views(spark, Wms.from_testdata(spark, SMALL), "2001-07-20 12:00:00",
                           "2024-01-10 12:00:00", prefix="t_")
    assert "t_lpn" in names and "t_appointments" in names
    n = spark.sql("SELECT count(*) FROM t_shipment_activity WHERE global_advancement IS NOT NULL").first()[0]
    assert n == spark.table("t_shipment_activity").count() > 0
    out = str(tmp_path / "activity")
    assert main(["--testdata", SMALL, "--report", "shipment_activity", "--as-of", "2001-07-20 12:00:00",
                 "--out", out]) == 0
    assert spark.read.parquet(out).count() == n


def test_fixture_clock_counts(spark):
    """Counts stated in FIXTURES.md §3 for the fixture clocks (sf0.001)."""
    from quaysight.plans.registry import QUERIES
    from tests.conftest import SMALL

    assert QUERIES["active_shipments"](spark, SMALL).count() == 12
    act = QUERIES["shipment_activity"](spark, SMALL)
    assert act.select("tc_shipment_id").distinct().count() == 9
    assert len(QUERIES["not_closed_list"](spark, SMALL).first()[0].split(" ")) == 4
    assert QUERIES["appointment_window"](spark, SMALL).count() == 75
    assert QUERIES["appointment_window_friday"](spark, SMALL).count() == 137
