"""Shipment-level building blocks of the activity and dock-door reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.functions.clock import (
    MASK_DAY_MONTH,
    MASK_DAY_MONTH_YEAR_TIME,
    MASK_TIME,
    AsOf,
    after_day_offset,
    between_midnights,
    to_char,
)
from quaysight.functions.semantics import ora_concat, ora_substr
from quaysight.operators.lists import lists_in_parts

# Shipment status band of shipments in progress, the order type
# of store deliveries, and the look-back days of the two clock windows.
ACTIVE_STATUS_LOW, ACTIVE_STATUS_HIGH = 40, 79
STORE_ORDER_TYPE = "10"
OPEN_DAYS_BACK = 4
NOT_CLOSED_FROM_DAYS, NOT_CLOSED_TO_DAYS = 10, 5


def in_progress(shipment: DataFrame) -> DataFrame:
    return shipment.filter(F.col("shipment_status").between(ACTIVE_STATUS_LOW, ACTIVE_STATUS_HIGH))


def active_shipments(shipment: DataFrame, as_of: AsOf, days_back: int = OPEN_DAYS_BACK) -> DataFrame:
    """Shipments in progress whose pickup day is after TRUNC(as_of - days_back)."""
    return in_progress(shipment).filter(after_day_offset("pickup_start_dttm", as_of, days_back))


def shipments_with_order_type(lpn: DataFrame, do_orders: DataFrame,
                              order_type: str = STORE_ORDER_TYPE) -> DataFrame:
    """Distinct shipment_id of pieces whose order has ``order_type``.

    Pieces are kept by a semi join to the typed orders (no row multiplication
    from the order side), then reduced to their distinct shipment keys.
    """
    typed = do_orders.filter(F.col("do_type") == order_type).select("order_id")
    pieces = lpn.filter(F.col("shipment_id").isNotNull()).select("order_id", "shipment_id")
    return pieces.join(typed, "order_id", "left_semi").select("shipment_id").distinct()


def shipments_with_order_type_distinct(lpn: DataFrame, do_orders: DataFrame,
                                       order_type: str = STORE_ORDER_TYPE) -> DataFrame:
    """Source shape: orders LEFT JOIN pieces, filtered, then DISTINCT."""
    o = do_orders.select("order_id", "do_type")
    pieces = lpn.select(F.col("order_id").alias("_l_order_id"), "shipment_id")
    j = o.join(pieces, o.order_id == pieces._l_order_id, "left")
    return j.filter((F.col("do_type") == order_type) & F.col("shipment_id").isNotNull()) \
        .select("shipment_id").distinct()


def id_split(code_col: str = "tc_shipment_id"):
    """(all but the last 5 characters, the last 5) of an external code."""
    code = F.col(code_col)
    return (ora_substr(code, 1, F.length(code) - 5), ora_substr(code, -5))


def location_code(aisle, lvl):
    """Last character of the aisle followed by the level ('A12','03' -> '203')."""
    return ora_concat(ora_substr(aisle, -1, 1), lvl)


def door_code(name):
    """First character and last two of a door name ('Q007' -> 'Q07')."""
    return ora_concat(ora_substr(name, 1, 1), ora_substr(name, -2, 2))


def carrier_code():
    """The designated carrier, else the assigned one."""
    return F.coalesce(F.col("dsg_carrier_code"), F.col("assigned_carrier_code"))


def pickup_labels(ts_col: str = "pickup_start_dttm", prefix: str = "pickup_start"):
    ts = F.col(ts_col)
    return [to_char(ts, MASK_DAY_MONTH_YEAR_TIME).alias(prefix),
            to_char(ts, MASK_DAY_MONTH).alias(f"{prefix}_date"),
            to_char(ts, MASK_TIME).alias(f"{prefix}_hour")]


def staging_locations(shipment: DataFrame, locn_hdr: DataFrame) -> DataFrame:
    """(shipment_id, location) - LEFT JOIN of the staging location."""
    s = shipment.select("shipment_id", "staging_locn_id")
    loc = locn_hdr.select("locn_id", "aisle", "lvl")
    j = s.join(loc, s.staging_locn_id == loc.locn_id, "left")
    return j.select("shipment_id", location_code(F.col("aisle"), F.col("lvl")).alias("location"))


def door_assignments(dock_door_ref: DataFrame, dock_door: DataFrame) -> DataFrame:
    """(shipment_id, dock_door_name, dock_door): one row per assigned door."""
    ref = dock_door_ref.select("shipment_id", "dock_door_id")
    doors = dock_door.select("dock_door_id", "dock_door_name")
    j = ref.join(doors, "dock_door_id", "inner")
    return j.select("shipment_id", "dock_door_name", door_code(F.col("dock_door_name")).alias("dock_door"))


def not_closed_list(shipment: DataFrame, lpn: DataFrame, as_of: AsOf,
                    from_days: int = NOT_CLOSED_FROM_DAYS, to_days: int = NOT_CLOSED_TO_DAYS) -> DataFrame:
    """One row: the space-separated, ordered codes of shipments still in
    progress whose pickup lies between TRUNC(as_of-10) and TRUNC(as_of-5) and
    which have at least one piece (NULL when there is none).

    The EXISTS test streams ``lpn`` against the windowed shipment keys.  All
    codes are one group, so they are listed in parts, by range.
    """
    late = in_progress(shipment).filter(between_midnights("pickup_start_dttm", as_of, from_days, to_days)) \
        .select("shipment_id", "tc_shipment_id")
    with_pieces = lpn.select("shipment_id").join(late.select("shipment_id"), "shipment_id", "left_semi")
    late = late.join(with_pieces, "shipment_id", "left_semi")
    return lists_in_parts(late, [], "tc_shipment_id", "not_closed")
