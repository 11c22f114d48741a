"""Report 2: dock doors (22 columns), ordered by door, then stop descending.

Grain: the distinct combinations of the 21 grouped values of every
(open shipment x door x delivery stop x city x order note x addition note),
plus the shipment's truncated loaded percentage.

Plan
----
The source query LEFT JOINs every piece of the shipment to every report row
and computes the percentage in the final GROUP BY.  Here the pieces are
summed per shipment first (``load_percentage``, exact - see its docstring),
so the fan-out of pieces x notes x stops is never materialised.  Per
destination stage counts for both container segments come from a single
aggregation.  Open shipments (status < 80) are a small, recent part of the
shipment history, so pieces and notes are first cut to them, and the open
pieces are written once - tagged with the key they were met by - and read by
the stage counts, the loaded totals and the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.functions.clock import MASK_DAY_MONTH, MASK_DAY_MONTH_YEAR_TIME, MASK_TIME, to_char
from quaysight.operators import left_join_dealt, materialize, materialize_all, restrict_to
from quaysight.operators.dock import (
    OPEN_STATUS_BELOW,
    load_percentage,
    loaded_weight,
    shipment_stops,
    stop_stage_counts,
)
from quaysight.operators.notes import TAG_ADDITION, TAG_ORDER, attach_notes_checked
from quaysight.operators.shipments import id_split
from quaysight.sources.catalog import Wms

DOCK_COLUMNS = (
    "porte_de_quai", "chargement", "chgt_left", "chgt_right", "pickup", "pickup_date", "pickup_hour",
    "arret", "ctmq", "ville", "metrage", "transporteur",
    "nb_prep_meca", "nb_ancr_meca", "nb_chgt_meca", "nb_prep_tradi", "nb_ancr_tradi", "nb_chgt_tradi",
    "percentage", "poids_charge", "note_ordre", "note_rajout",
)
GROUP_COLUMNS = [c for c in DOCK_COLUMNS if c != "percentage"]


PIECE_COLUMNS = ("shipment_id", "tc_shipment_id", "d_facility_alias_id", "lpn_facility_status", "container_type",
                 "curr_sub_locn_id", "estimated_weight")


def open_shipment_keys(w: Wms) -> DataFrame:
    """(shipment_id, tc_shipment_id) of the open shipments, written once so
    that the joins cutting ``lpn`` and ``shipment_note`` see its real
    size and broadcast it (a filtered scan is estimated at the whole table)."""
    open_ships = w.shipment.filter(F.col("shipment_status") < OPEN_STATUS_BELOW)
    return materialize(open_ships.select("shipment_id", "tc_shipment_id"), "open_shipments")


def tagged_pieces(lpn: DataFrame, keys: DataFrame) -> DataFrame:
    """The pieces that meet an open shipment by its id (``_by_id``), by its
    code (``_by_code``) or by both, in one scan of ``lpn``: the counts join on
    the id, the weight on the code.  The key sets are distinct, so the outer
    joins only tag; a NULL key meets nothing, and pieces with one are dealt by
    the other."""
    ids = keys.select(F.col("shipment_id").alias("_id")).distinct().withColumn("_by_id", F.lit(True))
    codes = keys.select(F.col("tc_shipment_id").alias("_code")).distinct().withColumn("_by_code", F.lit(True))
    pieces = lpn.select(*PIECE_COLUMNS).filter(F.col("shipment_id").isNotNull() | F.col("tc_shipment_id").isNotNull())
    pieces = left_join_dealt(pieces, ids, "shipment_id", "_id", ["tc_shipment_id"])
    pieces = left_join_dealt(pieces, codes, "tc_shipment_id", "_code", ["shipment_id"])
    return pieces.filter(F.col("_by_id") | F.col("_by_code")).select(*PIECE_COLUMNS, "_by_id", "_by_code")


def open_inputs(w: Wms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces by shipment id, notes, pieces by shipment code) of the open
    shipments, written once and concurrently: stage counts, loaded totals and
    weights read the written pieces and each note tag reads the written notes,
    while ``lpn`` and ``shipment_note`` (the whole history) are scanned once
    each."""
    keys = open_shipment_keys(w)
    written = materialize_all({
        "open_pieces": tagged_pieces(w.lpn, keys),
        "open_notes": restrict_to(w.shipment_note, keys, "shipment_id"),
    })
    pieces = written["open_pieces"]
    return pieces.filter("_by_id"), written["open_notes"], pieces.filter("_by_code")


def dock_rows(w: Wms, inputs: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All report rows before the final grouping, with the shipment key.

    Every piece-level input is cut to the open shipments first: the pieces by
    shipment id, the loaded weight by shipment code (the source joins weight
    on the code), the notes by shipment id.
    """
    pieces, notes, coded = inputs if inputs is not None else open_inputs(w)
    rows = shipment_stops(w.shipment, w.dock_door_ref, w.dock_door, w.stop, w.facility_alias)
    counts = stop_stage_counts(pieces, w.locn_hdr).withColumnRenamed("shipment_id", "_c_shipment_id")
    rows = rows.join(counts, (rows.shipment_id == counts._c_shipment_id)
                     & (rows.facility_alias_id == counts.d_facility_alias_id), "left")
    rows = rows.join(loaded_weight(coded), "tc_shipment_id", "left")
    rows = attach_notes_checked(rows, notes, {"note_ordre": TAG_ORDER, "note_rajout": TAG_ADDITION})
    left, right = id_split("tc_shipment_id")
    ts = F.col("pickup_start_dttm")
    return rows.select(
        "shipment_id",
        F.col("dock_door_name").alias("porte_de_quai"), F.col("tc_shipment_id").alias("chargement"),
        left.alias("chgt_left"), right.alias("chgt_right"),
        to_char(ts, MASK_DAY_MONTH_YEAR_TIME).alias("pickup"), to_char(ts, MASK_DAY_MONTH).alias("pickup_date"),
        to_char(ts, MASK_TIME).alias("pickup_hour"),
        F.col("stop_seq").alias("arret"), F.col("facility_alias_id").alias("ctmq"), F.col("city").alias("ville"),
        F.col("size1_value").alias("metrage"), F.col("assigned_carrier_code").alias("transporteur"),
        "nb_prep_meca", "nb_ancr_meca", "nb_chgt_meca", "nb_prep_tradi", "nb_ancr_tradi", "nb_chgt_tradi",
        F.col("weight").alias("poids_charge"), "note_ordre", "note_rajout")


def dock_order() -> list[Column]:
    """Source order: door ascending with NULLs last, stop descending with NULLs
    first; the shipment code after them lets the range sort split a busy door."""
    return [F.col("porte_de_quai").asc_nulls_last(), F.col("arret").desc_nulls_first(), F.col("chargement").asc()]


def _finish(grouped: DataFrame, ordered: bool) -> DataFrame:
    out = grouped.select(*DOCK_COLUMNS)
    return out.orderBy(*dock_order()) if ordered else out


def dock_doors(w: Wms, ordered: bool = True) -> DataFrame:
    inputs = open_inputs(w)
    return _finish(load_percentage(dock_rows(w, inputs), inputs[0], GROUP_COLUMNS), ordered)
