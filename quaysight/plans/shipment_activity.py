"""Report 1: outbound shipments in progress (45 columns).

Grain: one row per shipment in progress (status 40..79, pickup day after
TRUNC(as_of - 4)) that has a store order (type '10') among its pieces and at
least one piece, multiplied by its assigned doors, its tied last loaders and
its '#', '$' and '@' notes.

Plan
----
The driving set (active shipments) is tiny compared with the piece, tracking
and lock tables, so every large input is first cut to the rows of those
shipments with a LEFT SEMI join (``restrict_to``): the big table is streamed
against a hash table of the driving keys instead of being aggregated whole
and shuffled.  The driving sets that several branches reuse (the pieces of
the watched shipments, the typed shipments) are written once to the
checkpoint folder (``materialize``), so ``lpn`` and ``do_orders`` are each
read once and the plan stays small.  Stage
counts of all three segments come from one aggregation; first/last events
use the skew-safe extreme join; the one-row not-closed list is attached by a
broadcast of exactly one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.functions.clock import (
    MASK_DAY_MONTH,
    MASK_DAY_MONTH_TIME,
    MASK_TIME,
    AsOf,
    as_of_col,
    after_day_offset,
    between_midnights,
    to_char,
)
from quaysight.functions.semantics import proper_name
from quaysight.operators import materialize, restrict_to
from quaysight.operators.extremes import load_first_last, lock_first_last
from quaysight.operators.notes import TAG_DETOUR, TAG_ORDER, TAG_USERS, attach_notes_checked
from quaysight.operators.shipments import (
    NOT_CLOSED_FROM_DAYS,
    NOT_CLOSED_TO_DAYS,
    OPEN_DAYS_BACK,
    STORE_ORDER_TYPE,
    carrier_code,
    door_assignments,
    id_split,
    in_progress,
    location_code,
    not_closed_list,
    pickup_labels,
)
from quaysight.operators.stages import ACTIVITY_RULE, classified_pieces, stage_segments
from quaysight.sources.catalog import Wms

ACTIVITY_COLUMNS = (
    "tc_shipment_id", "tc_shipment_id_left", "tc_shipment_id_right", "carrier_code", "store_code",
    "debord", "pickup_start", "pickup_start_date", "pickup_start_hour", "location", "users",
    "dock_door", "start_of_loading", "start_of_loading_date", "start_of_loading_hour", "coch",
    "global_advancement", "global_prep", "global_ancr", "global_chgt",
    "meca_advancement", "meca_prep", "meca_ancr", "meca_chgt",
    "tradi_advancement", "tradi_prep", "tradi_ancr", "tradi_chgt",
    "global_nb_prep", "global_nb_ancr", "global_nb_chgt",
    "meca_nb_prep", "meca_nb_ancr", "meca_nb_chgt",
    "tradi_nb_prep", "tradi_nb_ancr", "tradi_nb_chgt",
    "not_closed", "opti_nom_debut", "opti_date_debut", "opti_nom_fin", "opti_date_fin",
    "ref_field1", "ref_field2", "ref_field3",
)


PIECE_COLUMNS = ("lpn_id", "order_id", "shipment_id", "lpn_facility_status", "container_type", "curr_sub_locn_id")


def watched_shipments(w: Wms, as_of: AsOf) -> DataFrame:
    """Shipments in progress that either report reads: the active ones and
    the late ones of the not-closed list (one scan of ``shipment``)."""
    earliest = F.date_sub(F.to_date(as_of_col(as_of)), max(OPEN_DAYS_BACK, NOT_CLOSED_FROM_DAYS))
    watched = in_progress(w.days("shipment", earliest)).filter(
        after_day_offset("pickup_start_dttm", as_of, OPEN_DAYS_BACK)
        | between_midnights("pickup_start_dttm", as_of, NOT_CLOSED_FROM_DAYS, NOT_CLOSED_TO_DAYS))
    return watched.withColumn("_active", after_day_offset("pickup_start_dttm", as_of, OPEN_DAYS_BACK))


def shipment_activity(w: Wms, as_of: AsOf, order_type: str = STORE_ORDER_TYPE) -> DataFrame:
    # Driving sets, written once and read back from the checkpoint folder:
    # the watched shipments first, so that Spark sees their real (small)
    # size and streams ``lpn`` against a broadcast of their keys instead of
    # shuffling it (a filtered scan is estimated at the whole table's size);
    # then the pieces and the typed shipments, so ``lpn`` and ``do_orders``
    # are each scanned exactly once.
    watched = materialize(watched_shipments(w, as_of), "watched")
    pieces = materialize(restrict_to(w.lpn.select(*PIECE_COLUMNS), watched, "shipment_id"), "pieces")
    active = watched.filter(F.col("_active")).drop("_active")
    typed_orders = restrict_to(w.do_orders.filter(F.col("do_type") == order_type), pieces, "order_id")
    typed_ids = restrict_to(pieces, typed_orders, "order_id").select("shipment_id")
    ships = materialize(restrict_to(active, typed_ids, "shipment_id"), "ships")
    ship_pieces = restrict_to(pieces, ships, "shipment_id")

    segments = stage_segments(classified_pieces(ship_pieces, w.locn_hdr, ACTIVITY_RULE))
    trkg = restrict_to(w.prod_trkg_tran, ships, "ref_field_1", "tc_shipment_id")
    locks_of_ships = restrict_to(w.lpn_lock, ship_pieces, "lpn_id")
    notes = materialize(restrict_to(w.shipment_note, ships, "shipment_id"), "notes")
    loads = load_first_last(trkg, w.ucl_user)
    locks = lock_first_last(ship_pieces, locks_of_ships, w.ucl_user)
    doors = door_assignments(restrict_to(w.dock_door_ref, ships, "shipment_id"), w.dock_door) \
        .select("shipment_id", "dock_door")
    not_closed = not_closed_list(watched.drop("_active"), pieces, as_of)

    loc = w.locn_hdr.select("locn_id", "aisle", "lvl")
    out = (ships.join(loc, ships.staging_locn_id == loc.locn_id, "left")
           .join(doors, "shipment_id", "left")
           .join(loads, "tc_shipment_id", "left")
           .join(segments, "shipment_id", "inner"))   # a shipment without pieces is not shown
    out = out.join(locks, "shipment_id", "left")
    out = attach_notes_checked(out, notes, {"debord": TAG_DETOUR, "users": TAG_USERS, "coch": TAG_ORDER})
    out = out.crossJoin(F.broadcast(not_closed))    # exactly one row

    left, right = id_split("tc_shipment_id")
    loading = F.col("start_of_loading")
    return out.select(
        "tc_shipment_id", left.alias("tc_shipment_id_left"), right.alias("tc_shipment_id_right"),
        carrier_code().alias("carrier_code"), F.col("broker_ref").alias("store_code"),
        "debord", *pickup_labels(), location_code(F.col("aisle"), F.col("lvl")).alias("location"),
        "users", "dock_door",
        to_char(loading, MASK_DAY_MONTH_TIME).alias("start_of_loading"),
        to_char(loading, MASK_DAY_MONTH).alias("start_of_loading_date"),
        to_char(loading, MASK_TIME).alias("start_of_loading_hour"),
        "coch",
        *[F.col(f"{seg}_{c}") for seg in ("global", "meca", "tradi")
          for c in ("advancement", "prep", "ancr", "chgt")],
        *[F.col(f"{seg}_nb_{c}") for seg in ("global", "meca", "tradi") for c in ("prep", "ancr", "chgt")],
        "not_closed",
        proper_name("min_first_name").alias("opti_nom_debut"),
        to_char(F.col("min_created_dttm"), MASK_DAY_MONTH_TIME).alias("opti_date_debut"),
        proper_name("max_first_name").alias("opti_nom_fin"),
        to_char(F.col("max_created_dttm"), MASK_DAY_MONTH_TIME).alias("opti_date_fin"),
        F.col("last_loader").alias("ref_field1"), F.lit(0).alias("ref_field2"), F.lit(0).alias("ref_field3"),
    )
