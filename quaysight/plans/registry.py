"""Named queries: every report and every operator as ``(spark, sf_dir) -> DataFrame``.

The inputs are the warehouse tables derived from the test data of
``sf_dir`` (``Wms.from_testdata``); the clocks are the fixture clocks of
FIXTURES.md §3.  Operator queries run over whole tables - no id subset, no
row cap - so their work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.functions.clock import business_day_window, minutes_of_day_since, minutes_since
from quaysight.functions.semantics import zero_if_null_decimal
from quaysight.operators import extremes, stages
from quaysight.operators.appointments import dock_pole, eligibility
from quaysight.operators.clocks import active_shipments_by_clock, clock_table, not_closed_by_clock
from quaysight.operators.dock import (
    load_percentage,
    load_percentage_by_multiplicity,
    loaded_weight,
    shipment_stops,
    stop_stage_counts,
)
from quaysight.operators.eav import attach_attributes_by_joins, attach_attributes_checked
from quaysight.operators.notes import TAG_ADDITION, TAG_DETOUR, TAG_ORDER, TAG_USERS, attach_notes_checked, po_priority
from quaysight.operators.purchase import appointment_po_rollup, hot_appointments, po_lists
from quaysight.operators.rejects import split_attributes
from quaysight.operators.shipments import (
    active_shipments,
    carrier_code,
    door_assignments,
    id_split,
    not_closed_list,
    pickup_labels,
    shipments_with_order_type,
    shipments_with_order_type_distinct,
    staging_locations,
)
from quaysight.plans.appointments import appointment_timeline, appointments, appointments_by_clock, po_split_for
from quaysight.plans.dock_doors import dock_doors
from quaysight.plans.shipment_activity import shipment_activity
from quaysight.sources.catalog import Wms

# Fixture clocks (FIXTURES.md §3).
ACTIVITY_AS_OF = "2001-07-20 12:00:00"
APPOINTMENT_AS_OF = "2024-01-10 12:00:00"          # a Wednesday
APPOINTMENT_AS_OF_FRIDAY = "2024-01-12 12:00:00"   # a Friday

# A week of clocks for the runs with many.
ACTIVITY_WEEK = tuple(f"2001-07-{d} 12:00:00" for d in range(16, 23))
APPOINTMENT_WEEK = tuple(f"2024-01-{d:02d} 12:00:00" for d in range(8, 15))

QueryFn = Callable[[SparkSession, str], DataFrame]
WmsQueryFn = Callable[[Wms], DataFrame]


_WMS: dict[str, tuple[SparkSession, Wms]] = {}


def _wms(spark: SparkSession, sf_dir: str) -> Wms:
    """The derived warehouse tables of ``sf_dir``, built once per session (a
    new or restarted session gets its own)."""
    key = sf_dir.rstrip("/")
    cached = _WMS.get(key)
    if cached is None or cached[0] is not spark or spark.sparkContext._jsc is None:
        cached = (spark, Wms.from_testdata(spark, sf_dir))
        _WMS[key] = cached
    return cached[1]


# ------------------------------------------------------------ reports ------
def q_shipment_activity(w):
    return shipment_activity(w, ACTIVITY_AS_OF)


def q_dock_doors(w):
    return dock_doors(w)


def q_appointments(w):
    return appointments(w, APPOINTMENT_AS_OF)


def q_appointments_friday(w):
    return appointments(w, APPOINTMENT_AS_OF_FRIDAY)


def q_appointments_week(w):
    return appointments_by_clock(w, APPOINTMENT_WEEK)


# ------------------------------------------------------------ shipments ----
def q_carrier_fallback(w):
    return w.shipment.select("shipment_id", carrier_code().alias("carrier_code"))


def q_id_split(w):
    left, right = id_split("tc_shipment_id")
    return w.shipment.select(
        "tc_shipment_id", left.alias("tc_shipment_id_left"), right.alias("tc_shipment_id_right"))


def q_time_labels(w):
    return w.shipment.select("shipment_id", *pickup_labels())


def q_active_shipments(w):
    return active_shipments(w.shipment, ACTIVITY_AS_OF).select(
        "shipment_id", "tc_shipment_id", "shipment_status", "pickup_start_dttm")


def q_active_shipments_week(w):
    return active_shipments_by_clock(w.shipment, clock_table(w.shipment.sparkSession, ACTIVITY_WEEK)).select(
        "as_of", "shipment_id", "tc_shipment_id", "shipment_status", "pickup_start_dttm")


def q_not_closed_week(w):
    return not_closed_by_clock(w.shipment, w.lpn, clock_table(w.shipment.sparkSession, ACTIVITY_WEEK))


def _typed(w, fn):
    ids = fn(w.lpn, w.do_orders)
    return w.shipment.join(ids, "shipment_id", "inner").select("shipment_id", "tc_shipment_id")


def q_shipments_with_do_type(w):
    ids = shipments_with_order_type(w.lpn, w.do_orders)
    return w.shipment.join(ids, "shipment_id", "left_semi").select("shipment_id", "tc_shipment_id")


def q_shipments_with_do_type_distinct(w):
    return _typed(w, shipments_with_order_type_distinct)


def q_staging_location(w):
    return staging_locations(w.shipment, w.locn_hdr)


def q_door_assignments(w):
    return door_assignments(w.dock_door_ref, w.dock_door)


def q_note_tags(w):
    return attach_notes_checked(w.shipment.select("shipment_id"), w.shipment_note,
                        {"debord": TAG_DETOUR, "users": TAG_USERS, "coch": TAG_ORDER,
                         "addition": TAG_ADDITION})


def q_not_closed_list(w):
    return not_closed_list(w.shipment, w.lpn, ACTIVITY_AS_OF)


# --------------------------------------------------------------- stages ----
def _pieces(w, rule=stages.ACTIVITY_RULE):
    return stages.classified_pieces(w.lpn, w.locn_hdr, rule)


def _counts(segment):
    def q(w):
        return stages.stage_counts(_pieces(w), segment=segment)
    return q


SEGMENT_COLUMNS = [f"{seg}_{c}" for seg in stages.SEGMENTS
                   for c in ("nb_prep", "nb_ancr", "nb_chgt", "prep", "ancr", "chgt", "advancement")]


def q_piece_stage_segments(w):
    return stages.stage_segments(_pieces(w)).select("shipment_id", *SEGMENT_COLUMNS)


def q_piece_stage_segments_three_scans(w):
    return stages.stage_segments_three_scans(_pieces(w)).select("shipment_id", *SEGMENT_COLUMNS)


def q_piece_stage_share(w):
    counts = stages.with_shares(stages.stage_counts(_pieces(w)))
    return counts.select("shipment_id", "prep", "ancr", "chgt", F.col("advancement").alias("loading_advancement"),
                         "nb_prep", "nb_ancr", "nb_chgt")


# ------------------------------------------------------------ first/last ---
def q_load_first_last(w, fn=extremes.load_first_last):
    return fn(w.prod_trkg_tran, w.ucl_user)


def q_lock_first_last(w, fn=extremes.lock_first_last):
    return fn(w.lpn, w.lpn_lock, w.ucl_user)


# ----------------------------------------------------------------- dock ----
def q_shipment_stops(w):
    return shipment_stops(w.shipment, w.dock_door_ref, w.dock_door, w.stop, w.facility_alias).select(
        "shipment_id", "dock_door_name", "stop_seq", "facility_alias_id", "city")


def q_stop_stage_counts(w):
    return stop_stage_counts(w.lpn, w.locn_hdr)


def _percentage(fn):
    def q(w):
        rows = shipment_stops(w.shipment, w.dock_door_ref, w.dock_door, w.stop, w.facility_alias)
        return fn(rows, w.lpn, ["shipment_id", "dock_door_name", "stop_seq"])
    return q


def q_loaded_weight(w):
    return loaded_weight(w.lpn)


# --------------------------------------------------------- appointments ----
def q_appointment_window(w, as_of=APPOINTMENT_AS_OF):
    a = w.ilm_appointments
    return a.filter(business_day_window("scheduled_dttm", as_of)).select("appointment_id", "scheduled_dttm")


def q_appointment_window_friday(w):
    return q_appointment_window(w, APPOINTMENT_AS_OF_FRIDAY)


def q_po_priority(w):
    po = w.purchase_orders.select("purchase_orders_id")
    j = po.join(w.purchase_orders_note, "purchase_orders_id", "left")
    return j.select("purchase_orders_id", "note", po_priority(F.col("note")).alias("purchase_orders_priority"))


def _split(w):
    return po_split_for(w, w.ilm_appointment_objects, restrict=False)


def q_po_split(w):
    return _split(w)


def q_po_lists(w):
    return po_lists(_split(w), hot_appointments(w.ilm_appointment_objects))


def q_appointment_po_rollup(w):
    return appointment_po_rollup(_split(w), hot_appointments(w.ilm_appointment_objects))


def q_eav_attributes(w):
    return attach_attributes_by_joins(w.ilm_appointments.select("appointment_id"), w.ilm_appt_custom_attribute)


def q_eav_attributes_pivot(w):
    return attach_attributes_checked(w.ilm_appointments.select("appointment_id"), w.ilm_appt_custom_attribute)


def q_eav_quantities(w):
    j = attach_attributes_checked(w.ilm_appointments.select("appointment_id"), w.ilm_appt_custom_attribute,
                          {"nb_pal": "NB_PALETTE", "nb_package": "NBR_COLIS"})
    return j.select("appointment_id", zero_if_null_decimal("nb_pal").alias("nb_palette"),
                    zero_if_null_decimal("nb_package").alias("nb_package"))


# Attributes that a site could take for quantities; arrival times are none.
QUANTITY_ATTRIBUTES = ("NB_PALETTE", "NBR_COLIS", "ARRIVAL_DTTM")


def q_rejected_quantities(w):
    return split_attributes(w.ilm_appt_custom_attribute, QUANTITY_ATTRIBUTES).rejected


def q_accepted_quantities(w):
    return split_attributes(w.ilm_appt_custom_attribute, QUANTITY_ATTRIBUTES).good.select(
        "appointment_id", "attribute_name", F.col("attribute_value").cast("decimal(10,3)").alias("quantity"))


def q_dock_pole(w):
    j = w.ilm_appt_slots.join(w.slots, "slot_id", "left")
    return j.select("appointment_id", "slot_id", F.col("description").alias("dock_group"),
                    dock_pole(F.col("description")).alias("dock_pole"))


def q_appointment_eligibility(w):
    rollup = appointment_po_rollup(_split(w), hot_appointments(w.ilm_appointment_objects))
    base = w.ilm_appointments.select("appointment_id").join(rollup, "appointment_id", "left")
    base = (base.join(w.ilm_appt_slots, "appointment_id", "left")
            .join(w.slots.select("slot_id", F.col("description").alias("dock_group")), "slot_id", "left"))
    base = attach_attributes_checked(base, w.ilm_appt_custom_attribute, {"nb_pal": "NB_PALETTE", "nb_package": "NBR_COLIS"})
    return base.select(
        "appointment_id", "appt_obj_type", "dock_group", "purchase_orders_running", "purchase_orders_closed",
        "nb_pal", "nb_package", "nb_lines",
        eligibility(F.col("purchase_orders_running"), F.col("purchase_orders_closed"), F.col("dock_group"),
                    F.col("nb_pal"), F.col("nb_package"), F.col("nb_lines")).alias("eligible"))


def q_trailer_tasks(w):
    return appointment_timeline(w)


def q_elapsed_minutes(w):
    t = appointment_timeline(w)
    return t.select("appointment_id", "trailer_id", "checkin_dttm", "min_task",
                    minutes_of_day_since(APPOINTMENT_AS_OF, "checkin_dttm").alias("checkin_dttm_gap"),
                    minutes_since(APPOINTMENT_AS_OF, "min_task").alias("start_dttm_gap"))


WMS_QUERIES: dict[str, WmsQueryFn] = {
    # reports
    "shipment_activity": q_shipment_activity,
    "dock_doors": q_dock_doors,
    "appointments": q_appointments,
    "appointments_friday": q_appointments_friday,
    "appointments_week": q_appointments_week,
    # operators
    "active_shipments_week": q_active_shipments_week,
    "not_closed_week": q_not_closed_week,
    "carrier_fallback": q_carrier_fallback,
    "eav_quantities": q_eav_quantities,
    "appointment_eligibility": q_appointment_eligibility,
    "dock_pole": q_dock_pole,
    "po_priority": q_po_priority,
    "po_split": q_po_split,
    "piece_stage_counts": _counts("global"),
    "piece_stage_counts_meca": _counts("meca"),
    "piece_stage_counts_tradi": _counts("tradi"),
    "piece_stage_segments": q_piece_stage_segments,
    "piece_stage_share": q_piece_stage_share,
    "trailer_tasks": q_trailer_tasks,
    "lock_first_last": q_lock_first_last,
    "load_first_last": q_load_first_last,
    "active_shipments": q_active_shipments,
    "not_closed_list": q_not_closed_list,
    "appointment_window": q_appointment_window,
    "appointment_window_friday": q_appointment_window_friday,
    "note_tags": q_note_tags,
    "door_assignments": q_door_assignments,
    "shipment_stops": q_shipment_stops,
    "shipments_with_do_type": q_shipments_with_do_type,
    "staging_location": q_staging_location,
    "stop_stage_counts": q_stop_stage_counts,
    "eav_attributes": q_eav_attributes,
    "rejected_quantities": q_rejected_quantities,
    "accepted_quantities": q_accepted_quantities,
    "appointment_po_rollup": q_appointment_po_rollup,
    "load_percentage": _percentage(load_percentage),
    "loaded_weight": q_loaded_weight,
    "po_lists": q_po_lists,
    "id_split": q_id_split,
    "elapsed_minutes": q_elapsed_minutes,
    "time_labels": q_time_labels,
    # rewrite forms (same rows as their base query)
    "load_first_last_selfjoin": lambda w: q_load_first_last(w, extremes.load_first_last_selfjoin),
    "load_first_last_window": lambda w: q_load_first_last(w, extremes.load_first_last_window),
    "lock_first_last_selfjoin": lambda w: q_lock_first_last(w, extremes.lock_first_last_selfjoin),
    "lock_first_last_window": lambda w: q_lock_first_last(w, extremes.lock_first_last_window),
    "piece_stage_segments_three_scans": q_piece_stage_segments_three_scans,
    "load_percentage_fanout": _percentage(load_percentage_by_multiplicity),
    "eav_attributes_pivot": q_eav_attributes_pivot,
    "shipments_with_do_type_distinct": q_shipments_with_do_type_distinct,
}


def _on_testdata(fn: WmsQueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_wms(spark, sf_dir))

    return run


QUERIES: dict[str, QueryFn] = {name: _on_testdata(fn) for name, fn in WMS_QUERIES.items()}

# Rewrite form -> the query whose rows it must reproduce.  The source's
# pair-emitting shapes (every report row joined to every piece of its
# shipment, every check-in to every later task of its trailer) are not
# registered; ``load_percentage_fanout`` evaluates the same fan-out sum by
# row multiplicities instead.  tests/test_rewrites.py checks the literal
# pair forms against the registered plans on the small fixture.
REWRITE_OF = {
    "load_percentage_fanout": "load_percentage",
    "eav_attributes_pivot": "eav_attributes",
    "load_first_last_selfjoin": "load_first_last",
    "load_first_last_window": "load_first_last",
    "lock_first_last_selfjoin": "lock_first_last",
    "lock_first_last_window": "lock_first_last",
    "piece_stage_segments_three_scans": "piece_stage_segments",
    "shipments_with_do_type_distinct": "shipments_with_do_type",
}
