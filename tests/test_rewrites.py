"""Rewrite equivalence on hand-made inputs that hold the traps:
ties (several first/last users), unknown users at an extreme, a NULL first
name, a NULL shipment, empty segments, duplicated attributes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaysight.operators import extremes, stages
from quaysight.operators.eav import REPORT_ATTRIBUTES, attach_attributes
from quaysight.operators.notes import attach_notes, tagged_notes
from quaysight.operators.purchase import po_split

T = [dt.datetime(2024, 1, 1, h) for h in range(10)]
LOAD, OTHER = "RF CHARGER OLPN", "RF AUTRE"


@pytest.fixture()
def users(spark):
    return spark.createDataFrame([("U1", "alice"), ("U2", "bob"), ("U3", None)],
                                 "user_name string, user_first_name string")


@pytest.fixture()
def trkg(spark):
    rows = [
        ("S1", LOAD, T[1], "U1", 1), ("S1", LOAD, T[1], "U2", 2), ("S1", LOAD, T[3], "U1", 3),
        ("S1", LOAD, T[3], "U3", 4), ("S1", OTHER, T[0], "U1", 5),
        ("S2", LOAD, T[1], "U9", 6), ("S2", LOAD, T[2], "U1", 7),     # first by an unknown user
        ("S3", LOAD, T[1], "U1", 8), ("S3", LOAD, T[2], "U9", 9),     # last by an unknown user
        ("S4", OTHER, T[1], "U1", 10),
    ]
    return spark.createDataFrame(rows, "ref_field_1 string, menu_optn_name string, create_date_time timestamp_ntz, "
                                       "user_id string, seq_nbr long")


@pytest.mark.parametrize("fn", [extremes.load_first_last, extremes.load_first_last_selfjoin,
                                extremes.load_first_last_window])
def test_load_first_last_traps(trkg, users, fn):
    got = sorted((tuple(r) for r in fn(trkg, users).collect()), key=str)
    assert got == sorted([("S1", T[1], "Alice"), ("S1", T[1], None), ("S3", T[1], None)], key=str)


@pytest.fixture()
def locks(spark):
    lpn = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, None)], "lpn_id long, shipment_id long")
    lk = spark.createDataFrame([
        (1, "OP", T[1], "U1"), (2, "OP", T[1], "U2"), (1, "OP", T[5], "U9"),
        (3, "OP", T[2], "U9"), (3, "OP", T[3], "U2"), (4, "OP", T[0], "U1"), (1, "QH", T[9], "U1"),
    ], "lpn_id long, inventory_lock_code string, created_dttm timestamp_ntz, created_source string")
    return lpn, lk


@pytest.mark.parametrize("fn", [extremes.lock_first_last, extremes.lock_first_last_selfjoin,
                                extremes.lock_first_last_window])
def test_lock_first_last_traps(locks, users, fn):
    lpn, lk = locks
    got = sorted(tuple(r) for r in fn(lpn, lk, users).collect())
    assert got == [(100, T[1], "alice", None, None), (200, None, None, T[3], "bob")]


def test_empty_segment_is_null(spark):
    lpn = spark.createDataFrame([
        (1, 10, "03", None, 10), (2, 10, "PTS", None, 50), (3, 11, None, None, 35), (4, 12, "10", None, 25),
    ], "lpn_id long, shipment_id long, container_type string, curr_sub_locn_id long, lpn_facility_status int")
    loc = spark.createDataFrame([], "locn_id long, locn_class string")
    pieces = stages.classified_pieces(lpn, loc, stages.ACTIVITY_RULE)
    one = {r.shipment_id: r for r in stages.stage_segments(pieces).collect()}
    three = {r.shipment_id: r for r in stages.stage_segments_three_scans(pieces).collect()}
    cols = [f"{s}_{c}" for s in stages.SEGMENTS for c in ("nb_prep", "nb_ancr", "nb_chgt", "prep", "ancr",
                                                           "chgt", "advancement")]
    for sid in (10, 11, 12):
        assert [one[sid][c] for c in cols] == [three[sid][c] for c in cols]
    assert one[10]["tradi_advancement"] is None and one[10]["meca_advancement"] == "050 / 000 / 050"
    assert one[11]["meca_nb_prep"] is None and one[11]["tradi_ancr"] == 100
    # status 25 with a NULL class counts as prep (NULL class branch)
    assert one[12]["global_prep"] == 100


def test_one_pass_attributes_equal_one_join_each(spark):
    attrs = spark.createDataFrame([
        (1, "NUM_CNT", "c1"), (1, "NB_PALETTE", "3"), (2, "NUM_CNT", "c2"), (2, "NUM_CNT", None),
        (2, "CUST_COMMENTS", "a"), (2, "CUST_COMMENTS", "b"), (4, "NB_PALETTE", "9"), (None, "NUM_CNT", "x"),
    ], "appointment_id long, attribute_name string, attribute_value string")
    appts = spark.createDataFrame([(1,), (2,), (3,), (None,)], "appointment_id long")
    joined = appts
    for alias, name in REPORT_ATTRIBUTES.items():
        one = attrs.filter(F.col("attribute_name") == name).select("appointment_id", F.col("attribute_value").alias(alias))
        joined = joined.join(one, "appointment_id", "left")
    out = attach_attributes(appts, attrs)
    assert out.columns == joined.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, joined.collect()))
    assert out.filter("appointment_id = 2").count() == 4   # 2 containers x 2 comments
    assert _scans(out) == 1


def test_one_pass_notes_equal_one_join_each(spark):
    notes = spark.createDataFrame([(1, "#a"), (1, "#b"), (1, "$u"), (2, "@"), (2, "+x"), (2, "+y"), (3, "zz"), (None, "#n")],
                                  "shipment_id long, note string")
    ships = spark.createDataFrame([(1,), (2,), (3,), (4,)], "shipment_id long")
    tags = {"debord": "#", "users": "$", "coch": "@", "addition": "+"}
    joined = ships
    for alias, tag in tags.items():
        one = tagged_notes(notes).filter(F.col("tag") == tag).select("shipment_id", F.col("body").alias(alias))
        joined = joined.join(one, "shipment_id", "left")
    out = attach_notes(ships, notes, tags)
    assert sorted(map(str, out.collect())) == sorted(map(str, joined.collect()))
    assert _scans(out) == 1


def _scans(df) -> int:
    """Scans besides that of the frame joined to."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") - 1


def test_po_split_weights_equal_fanout(spark):
    objects = spark.createDataFrame([(1, 7, 40), (1, 8, 40), (2, 9, 40), (3, 99, 40)],
                                    "appointment_id long, appt_obj_id long, appt_obj_type int")
    pos = spark.createDataFrame([(7, "3007", 400, 5), (8, "G008", 950, 5), (9, "C009", None, 6)],
                                "purchase_orders_id long, tc_purchase_orders_id string, "
                                "purchase_orders_status int, business_partner_id long")
    lines = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1)], "purchase_orders_id long, line_nbr int")
    partners = spark.createDataFrame([(5, "p"), (5, "p-dup"), (6, "q")], "business_partner_id long, description string")
    statuses = spark.createDataFrame([(400,), (950,)], "purchase_orders_status int")
    notes = spark.createDataFrame([(7, "PU1"), (7, "UR"), (7, "URx"), (9, None)], "purchase_orders_id long, note string")
    got = sorted((tuple(r) for r in po_split(objects, pos, lines, partners, statuses, notes).collect()), key=str)
    # PO 7: 3 lines x 2 partner rows x (1 'PU' note | 2 'UR' notes)
    assert got == sorted([
        (1, 40, "3007", None, 5, 1, 6), (1, 40, "3007", None, 5, 7, 12),
        (1, 40, None, "G008", 5, 8, 2),
        (2, 40, None, None, 6, 8, 1),
        (3, 40, None, None, None, 8, 1),
    ], key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fanout_forms_equal_preaggregated(spark):
    """The source's fan-out shapes (all pairs) against the registered plans,
    on the small fixture only."""
    from quaysight.operators.dock import (
        load_percentage,
        load_percentage_by_multiplicity,
        shipment_stops,
    )
    from quaysight.operators.trailers import trailer_tasks
    from quaysight.plans.dock_doors import dock_doors
    from tests.pair_forms import dock_doors_fanout, load_percentage_fanout, task_spans_range_join
    from quaysight.sources import Wms
    from tests.conftest import SMALL

    w = Wms.from_testdata(spark, SMALL)
    rows = shipment_stops(w.shipment, w.dock_door_ref, w.dock_door, w.stop, w.facility_alias)
    keys = ["shipment_id", "dock_door_name", "stop_seq"]
    pairs = _rows(load_percentage_fanout(rows, w.lpn, keys))
    assert _rows(load_percentage(rows, w.lpn, keys)) == pairs
    assert _rows(load_percentage_by_multiplicity(rows, w.lpn, keys)) == pairs
    assert _rows(dock_doors(w, ordered=False)) == _rows(dock_doors_fanout(w))
    args = (w.trailer_visit_detail, w.trailer_visit, w.trailer_ref, w.locn_hdr, w.ilm_tasks)
    assert _rows(trailer_tasks(*args)) == _rows(trailer_tasks(*args, spans_fn=task_spans_range_join))


def test_task_spans_ties_and_slices(spark):
    from quaysight.operators.trailers import task_spans
    from tests.pair_forms import task_spans_range_join

    d = dt.datetime
    spans = spark.createDataFrame([
        (1, d(2024, 1, 1, 8)), (1, d(2024, 1, 1, 23, 59)), (1, d(2024, 1, 3, 0)), (2, d(2024, 1, 2, 5)),
        (3, d(2024, 1, 1, 1)),
    ], "trailer_id long, checkin_dttm timestamp_ntz")
    tasks = spark.createDataFrame([
        (1, d(2024, 1, 1, 8), d(2024, 1, 1, 8)),        # equal to a check-in: counted
        (1, d(2024, 1, 1, 9), d(2024, 1, 4, 0)),        # late update
        (1, d(2024, 1, 2, 10), d(2024, 1, 2, 11)),      # next day slice
        (1, d(2024, 1, 1, 7), d(2024, 1, 9, 0)),        # before every check-in: never counted
        (2, d(2024, 1, 1, 5), d(2024, 1, 1, 6)),        # trailer 2 only has an earlier task
        (1, None, d(2024, 1, 5, 0)),                    # NULL creation never matches
        (None, d(2024, 1, 1, 9), d(2024, 1, 1, 9)),     # NULL trailer never matches
    ], "trailer_id long, created_dttm timestamp_ntz, last_updated_dttm timestamp_ntz")
    got = _rows(task_spans(spans, tasks))
    assert got == _rows(task_spans_range_join(spans, tasks).unionByName(
        spark.createDataFrame([(2, d(2024, 1, 2, 5), None, None), (1, d(2024, 1, 3, 0), None, None),
                               (3, d(2024, 1, 1, 1), None, None)],
                              "trailer_id long, checkin_dttm timestamp_ntz, min_task timestamp_ntz, "
                              "_max_update timestamp_ntz")))
    assert (1, d(2024, 1, 1, 8), d(2024, 1, 1, 8), d(2024, 1, 4, 0)) in got


def test_drop_materialized(spark):
    from quaysight.operators import _WRITTEN, drop_materialized, materialize

    df = materialize(spark.range(10).withColumnRenamed("id", "k"), "probe")
    assert df.count() == 10
    assert _WRITTEN and drop_materialized(spark) >= 1 and not _WRITTEN


def test_hot_trailer_and_hot_shipment(spark):
    """One trailer / one shipment holding most rows: the sliced suffix scan
    and the pre-aggregated first/last agree with brute force."""
    from quaysight.operators.trailers import task_spans
    from tests.pair_forms import task_spans_range_join

    d = dt.datetime
    base = d(2024, 1, 1)
    tasks = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(F.lit(0)).cast("long").alias("trailer_id"),
        F.timestamp_add("MINUTE", (F.col("id") * 37) % 5000, F.lit(base).cast("timestamp_ntz")).alias("created_dttm"),
        F.timestamp_add("MINUTE", (F.col("id") * 37) % 5000 + F.col("id") % 13, F.lit(base).cast("timestamp_ntz"))
        .alias("last_updated_dttm"))
    spans = spark.range(0, 200).select(
        (F.col("id") % 8).cast("long").alias("trailer_id"),
        F.timestamp_add("MINUTE", (F.col("id") * 53) % 5200, F.lit(base).cast("timestamp_ntz")).alias("checkin_dttm")
    ).distinct()
    fast = {(r[0], r[1]): (r[2], r[3]) for r in task_spans(spans, tasks).collect()}
    slow = {(r[0], r[1]): (r[2], r[3]) for r in task_spans_range_join(spans, tasks).collect()}
    assert all(fast[k] == v for k, v in slow.items())
    assert all(v == (None, None) for k, v in fast.items() if k not in slow)

    users = spark.createDataFrame([(f"U{i}", f"user{i}") for i in range(5)], "user_name string, user_first_name string")
    trkg = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))).otherwise(F.lit("HOT"))
        .alias("ref_field_1"),
        F.lit(LOAD).alias("menu_optn_name"),
        F.timestamp_add("HOUR", F.col("id") % 17, F.lit(base).cast("timestamp_ntz")).alias("create_date_time"),
        F.concat(F.lit("U"), (F.col("id") % 6).cast("string")).alias("user_id"),
        F.col("id").alias("seq_nbr"))
    got = _rows(extremes.load_first_last(trkg, users))
    assert got == _rows(extremes.load_first_last_window(trkg, users))
    assert got == _rows(extremes.load_first_last_selfjoin(trkg, users))
