"""Report 3: inbound appointments of today up to the next working day
(29 columns).

Grain: appointment x PO rollup of object type 40 (or none) x attribute
duplicates x slot x trailer visit rows, filtered by the eligibility rule and
the business-day window (Friday reaches Monday).

Plan
----
The window filter on ``scheduled_dttm`` is pushed to the appointment scan;
the surviving appointment ids then cut every other input (objects, POs, line
items, notes, attributes, slots, visits, tasks) with LEFT SEMI joins before
any aggregation, so the work is proportional to the appointments shown, not
to the history held in the tables.  Cut inputs that several branches reuse
(the window's objects, attributes and visits) are written once to the
checkpoint folder (``materialize``): each large table is read once, and the
checked pivot of the six attributes reads a small file.  The window itself is
a filtered scan pushed into parquet, cheap to repeat.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.functions.clock import (
    MASK_DAY_MONTH,
    MASK_TIME,
    AsOf,
    as_of_col,
    business_day_window,
    business_days_ahead,
    minutes_of_day_since,
    minutes_since,
    to_char,
)
from quaysight.functions.semantics import zero_if_null_decimal
from quaysight.operators import materialize, materialize_all, restrict_to
from quaysight.operators.appointments import dock_pole, eligibility
from quaysight.operators.clocks import business_windows, clock_table, rows_in_windows
from quaysight.operators.eav import attach_attributes_checked
from quaysight.operators.purchase import PO_OBJECT_TYPE, appointment_po_rollup, hot_appointments, po_split
from quaysight.operators.rejects import QUANTITY_TYPES, split_rejects
from quaysight.operators.trailers import trailer_tasks
from quaysight.sources.catalog import Wms

APPOINTMENT_COLUMNS = (
    "scheduled_date", "scheduled_time", "tc_appointment_id", "appointment_comments", "appointment_status",
    "tc_container_id", "nb_palette", "nb_package", "date_arrival", "send_to_dock", "dock_group", "dock_pole",
    "business_partner", "purchase_orders_running", "purchase_orders_closed", "purchase_orders_priority",
    "purchase_order_nb_lines", "checkin_dttm", "checkin_dttm_gap", "checkout_dttm", "trailer_type",
    "seal_number", "start_dttm", "start_dttm_gap", "end_dttm", "dsp_locn",
    "ref_field1", "ref_field2", "ref_field3",
)


def po_split_for(w: Wms, objects: DataFrame, restrict: bool) -> DataFrame:
    """``po_split`` over the given objects; with ``restrict`` the PO tables are
    first cut to the POs those objects reference."""
    pos, lines, notes = w.purchase_orders, w.purchase_orders_line_item, w.purchase_orders_note
    if restrict:
        # Only the rows of POs the objects reference can join (the PO key is
        # the object id), so all three tables are cut by the object ids.
        pos = restrict_to(pos, objects, "purchase_orders_id", "appt_obj_id")
        lines = restrict_to(lines, objects, "purchase_orders_id", "appt_obj_id")
        notes = restrict_to(notes, objects, "purchase_orders_id", "appt_obj_id")
    return po_split(objects, pos, lines, w.business_partner, w.purchase_orders_status, notes,
                    partner_is_key=w.has_key("business_partner", ("business_partner_id",)),
                    status_is_key=w.has_key("purchase_orders_status", ("purchase_orders_status",)))


def window_visits(w: Wms, appts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visit details, visits) of the given appointments; the visits are the
    part to write once (``materialize``) since three branches read them."""
    detail = restrict_to(w.trailer_visit_detail, appts, "appointment_id")
    return detail, restrict_to(w.trailer_visit, detail, "visit_id")


def appointment_timeline(w: Wms, appts: DataFrame | None = None,
                         visits: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``trailer_tasks`` for the given appointments (all when None); ``visits``
    are their (details, written visits) when already at hand."""
    detail, visit = w.trailer_visit_detail, w.trailer_visit
    tasks, ref = w.ilm_tasks, w.trailer_ref
    if appts is not None:
        if visits is None:
            detail, visit = window_visits(w, appts)
            visit = materialize(visit, "visits")
        else:
            detail, visit = visits
        ref = restrict_to(ref, visit, "active_visit_id", "visit_id")
        tasks = restrict_to(tasks, visit, "trailer_id")
    return trailer_tasks(detail, visit, ref, w.locn_hdr, tasks)


def window_appointments(w: Wms, as_of: AsOf) -> DataFrame:
    """The appointments of the clock's business-day window."""
    today = F.to_date(as_of_col(as_of))
    rows = w.days("ilm_appointments", today, F.date_add(today, business_days_ahead(today)))
    return rows.filter(business_day_window("scheduled_dttm", as_of))


def appointments(w: Wms, as_of: AsOf, rejects_to: str | None = None) -> DataFrame:
    """The report at one clock.  A quantity that is no number is an error, as
    in the source; with ``rejects_to`` its row goes to that folder instead,
    with the reason (``operators.rejects``)."""
    return _report(w, window_appointments(w, as_of), as_of_col(as_of), rejects_to).select(*APPOINTMENT_COLUMNS)


def appointments_by_clock(w: Wms, clocks: Iterable[AsOf]) -> DataFrame:
    """(as_of, the report's columns): the report of each clock, from one scan
    of the appointments and of every table behind them.  An appointment shown
    by several clocks is rolled up once."""
    windows = business_windows(clock_table(w.ilm_appointments.sparkSession, clocks))
    return _report(w, rows_in_windows(w.ilm_appointments, "scheduled_dttm", windows), F.col("as_of")).select("as_of", *APPOINTMENT_COLUMNS)


def _report(w: Wms, shown: DataFrame, as_of: Column, rejects_to: str | None = None) -> DataFrame:
    """The report over the appointments of one or more windows."""
    # The window's appointments are written first so that Spark sees their
    # real (small) size and streams the big tables against a broadcast of
    # their keys (a filtered scan is estimated at the whole table's size);
    # the cut inputs several branches reuse are then written concurrently.
    appts = materialize(shown, "appointments")
    written = materialize_all({
        "objects": restrict_to(w.ilm_appointment_objects, appts, "appointment_id"),
        "attributes": restrict_to(w.ilm_appt_custom_attribute, appts, "appointment_id"),
        "visit_detail": restrict_to(w.trailer_visit_detail, appts, "appointment_id"),
    })
    objects, attrs, detail = written["objects"], written["attributes"], written["visit_detail"]
    visits = materialize(restrict_to(w.trailer_visit, detail, "visit_id"), "visits")
    rollup = appointment_po_rollup(po_split_for(w, objects, restrict=True), hot_appointments(objects))
    slot_rows = restrict_to(w.ilm_appt_slots, appts, "appointment_id").select("appointment_id", "slot_id")
    slots = w.slots.select("slot_id", F.col("description").alias("dock_group"))
    timeline = appointment_timeline(w, appts, (detail, visits))

    status = w.ilm_appointment_status.select("appt_status_code", F.col("description").alias("appointment_status"))
    partner = w.business_partner.select("business_partner_id", F.col("description").alias("business_partner"))

    out = (appts.join(status, appts.appt_status == status.appt_status_code, "left")
           .join(rollup, "appointment_id", "left")
           .join(partner, "business_partner_id", "left"))
    out = (out.join(slot_rows, "appointment_id", "left")
           .join(slots, "slot_id", "left")
           .join(timeline, "appointment_id", "left"))
    out = attach_attributes_checked(out, attrs)   # last: no later join brings a salted appointment together again
    if rejects_to:
        split = split_rejects(out, QUANTITY_TYPES, "checked_appointments")
        split.rejected.write.mode("overwrite").parquet(rejects_to)
        out = split.good

    obj_type = F.col("appt_obj_type")
    shown = eligibility(F.col("purchase_orders_running"), F.col("purchase_orders_closed"), F.col("dock_group"),
                        F.col("nb_pal"), F.col("nb_package"), F.col("nb_lines"))
    out = out.filter(((obj_type == PO_OBJECT_TYPE) | obj_type.isNull()) & (shown == 1))

    ts = F.col("scheduled_dttm")
    return out.select(
        as_of.alias("as_of"), to_char(ts, MASK_DAY_MONTH).alias("scheduled_date"), to_char(ts, MASK_TIME).alias("scheduled_time"),
        "tc_appointment_id", F.col("comments").alias("appointment_comments"), "appointment_status",
        "tc_container_id",
        zero_if_null_decimal("nb_pal").alias("nb_palette"), zero_if_null_decimal("nb_package").alias("nb_package"),
        "date_arrival", "send_to_dock", "dock_group", dock_pole(F.col("dock_group")).alias("dock_pole"),
        "business_partner", "purchase_orders_running", "purchase_orders_closed", "purchase_orders_priority",
        F.col("nb_lines").alias("purchase_order_nb_lines"),
        "checkin_dttm", minutes_of_day_since(as_of, "checkin_dttm").alias("checkin_dttm_gap"),
        "checkout_dttm", F.col("type").alias("trailer_type"),
        # The source shows the trailer id under the seal-number heading.
        F.col("trailer_id").alias("seal_number"),
        F.col("min_task").alias("start_dttm"), minutes_since(as_of, "min_task").alias("start_dttm_gap"),
        F.col("max_task").alias("end_dttm"), "dsp_locn",
        F.col("cust_comments").alias("ref_field1"), F.lit(0).alias("ref_field2"), F.lit(0).alias("ref_field3"),
    )
