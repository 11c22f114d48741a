"""Purchase orders behind an appointment.

Two levels, as in the appointment report:

1. ``po_split`` - per (appointment, object type, running PO, closed PO,
   partner, note priority): the number of joined rows, i.e. line items x
   notes of each PO (1 when it has none).  A PO is 'running' unless its
   status is the closed code; a NULL status makes it neither.
2. ``appointment_po_rollup`` - per (appointment, object type): the running
   and closed POs as ordered space-separated lists (duplicates kept, NULLs
   skipped, NULL when empty), the largest partner id, the best priority and
   the total line count.

Scale: the source query multiplies every PO by its line items and notes and
counts the product.  Here line items, notes, partners and statuses are first
counted per key (map-side combined aggregates), and each object row carries
the product of those counts as a weight - the same numbers without
materialising the fan-out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.operators.lists import HOT_ROWS, grouped_lists, hot_groups
from quaysight.operators.notes import PO_PRIORITY_CODES, PO_PRIORITY_DEFAULT, po_priority

# The PO status code meaning 'closed'; the object type of POs.
PO_CLOSED_STATUS = 950
PO_OBJECT_TYPE = 40

PO_SPLIT_KEYS = ("appointment_id", "appt_obj_type", "purchase_orders_running",
                 "purchase_orders_closed", "business_partner_id", "purchase_orders_priority")


def _count_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def po_split(objects: DataFrame, purchase_orders: DataFrame, line_items: DataFrame,
             partners: DataFrame, statuses: DataFrame, notes: DataFrame,
             closed_status: int = PO_CLOSED_STATUS, partner_is_key: bool = False,
             status_is_key: bool = False) -> DataFrame:
    """The two joins to ``partners`` and ``statuses`` show no column; they only
    multiply rows where their key repeats.  With ``partner_is_key`` /
    ``status_is_key`` (a verified declaration, ``Wms.has_key``) the join is
    left out, else its count stays a factor of the weight."""
    obj = objects.select("appointment_id", "appt_obj_type", "appt_obj_id")
    po = purchase_orders.select("purchase_orders_id", "tc_purchase_orders_id",
                                "purchase_orders_status", "business_partner_id")
    n_lines = _count_by(line_items, ["purchase_orders_id"], "_n_lines")
    n_notes = _count_by(notes.select("purchase_orders_id", po_priority(F.col("note")).alias("_prio")),
                        ["purchase_orders_id", "_prio"], "_n_notes")
    # the counts join the POs before the objects do: objects without a PO
    # would all meet under a NULL key
    po = (po.filter(F.col("purchase_orders_id").isNotNull())
          .join(n_lines, "purchase_orders_id", "left")
          .join(n_notes, "purchase_orders_id", "left"))
    factors = ["_n_lines", "_n_notes"]
    for table, key, unique in ((partners, "business_partner_id", partner_is_key),
                               (statuses, "purchase_orders_status", status_is_key)):
        if not unique:
            factors.append(f"_n_{key}")
            po = po.join(_count_by(table, [key], factors[-1]), key, "left")
    rows = obj.join(po, obj.appt_obj_id == po.purchase_orders_id, "left")
    weight = reduce(lambda a, b: a * b, [F.coalesce(F.col(f), F.lit(1).cast("long")) for f in factors])
    status, code = F.col("purchase_orders_status"), F.col("tc_purchase_orders_id")
    return rows.groupBy(
        "appointment_id", "appt_obj_type",
        F.when(status != closed_status, code).alias("purchase_orders_running"),
        F.when(status == closed_status, code).alias("purchase_orders_closed"),
        "business_partner_id",
        F.coalesce(F.col("_prio"), F.lit(PO_PRIORITY_DEFAULT)).alias("purchase_orders_priority"),
    ).agg(F.sum(weight).alias("nb_lines"))


ROLLUP_KEYS = ["appointment_id", "appt_obj_type"]
LISTS = {c: c for c in ("purchase_orders_running", "purchase_orders_closed")}


def hot_appointments(objects: DataFrame, limit: int = HOT_ROWS) -> DataFrame | None:
    """Appointments whose PO lists are made in parts.  An object gives at most
    one split row for each of the eight note priorities."""
    return hot_groups(objects, ROLLUP_KEYS, limit // (len(PO_PRIORITY_CODES) + 1))


def appointment_po_rollup(split: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    return grouped_lists(split, ROLLUP_KEYS, LISTS, [
        F.max("business_partner_id").alias("business_partner_id"),
        F.min("purchase_orders_priority").alias("purchase_orders_priority"),
        F.sum("nb_lines").alias("nb_lines")], hot)


def po_lists(split: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Only the two ordered PO lists of the rollup."""
    return grouped_lists(split, ROLLUP_KEYS, LISTS, [], hot)
