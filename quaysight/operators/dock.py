"""Dock-door building blocks: stops, per-destination stage counts, loaded
percentage and loaded weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.functions.semantics import flag, trunc_ratio_pct
from quaysight.operators.stages import DOCK_RULE, classified_pieces, stage_segments

# Open shipments are below status 80; the first stop is the
# warehouse itself; the loaded status; statuses up to 99 count in the total.
OPEN_STATUS_BELOW = 80
FIRST_DELIVERY_STOP = 1
LOADED_STATUS = 50
COUNTED_STATUS_MAX = 99


def shipment_stops(shipment: DataFrame, dock_door_ref: DataFrame, dock_door: DataFrame,
                   stop: DataFrame, facility_alias: DataFrame) -> DataFrame:
    """Open shipments x assigned doors x delivery stops (after the first) x
    destination city; inner joins as in the dock-door report."""
    s = shipment.filter(F.col("shipment_status") < OPEN_STATUS_BELOW)
    doors = dock_door_ref.join(dock_door, "dock_door_id", "inner").select("shipment_id", "dock_door_name")
    st = stop.filter(F.col("stop_seq") > FIRST_DELIVERY_STOP).select("shipment_id", "stop_seq", "facility_alias_id")
    fa = facility_alias.select("facility_alias_id", "city")
    return (s.join(doors, "shipment_id", "inner")
            .join(st, "shipment_id", "inner")
            .join(fa, "facility_alias_id", "inner"))


def stop_stage_counts(lpn: DataFrame, locn_hdr: DataFrame) -> DataFrame:
    """Per (shipment_id, d_facility_alias_id): prep / staged / loaded counts
    of the mechanised and of the traditional pieces (dock classifier: class R
    only, loaded means status = 50).  A segment without pieces is NULL."""
    keys = ("shipment_id", "d_facility_alias_id")
    pieces = classified_pieces(lpn, locn_hdr, DOCK_RULE, keys=keys)
    seg = stage_segments(pieces, keys=keys, segments=("meca", "tradi"), shares=False)
    return seg.select(*keys, *[F.col(f"{s}_nb_{c}").alias(f"nb_{c}_{s}")
                               for s in ("meca", "tradi") for c in ("prep", "ancr", "chgt")])


def loaded_totals(lpn: DataFrame) -> DataFrame:
    """Per shipment: loaded pieces (status = 50) and counted pieces (status <= 99)."""
    status = F.col("lpn_facility_status")
    return (lpn.filter(F.col("shipment_id").isNotNull())
            .groupBy("shipment_id")
            .agg(F.sum(flag(status == LOADED_STATUS)).alias("nb_loaded"),
                 F.sum(flag(status <= COUNTED_STATUS_MAX)).alias("nb_counted")))


def loaded_weight(lpn: DataFrame) -> DataFrame:
    """(tc_shipment_id, weight): weight of the loaded pieces per shipment code."""
    return (lpn.filter((F.col("lpn_facility_status") == LOADED_STATUS) & F.col("tc_shipment_id").isNotNull())
            .groupBy("tc_shipment_id").agg(F.sum("estimated_weight").alias("weight")))


def load_percentage(rows: DataFrame, lpn: DataFrame, group_cols: list) -> DataFrame:
    """TRUNC(SUM(loaded) / SUM(counted) * 100) per group of ``rows``.

    The source query joins every piece row to every report row of its
    shipment and sums in the final GROUP BY.  Here the pieces are first
    summed per shipment (map-side combined), joined once per report row, and
    summed again per group: each report row of a shipment contributes the
    shipment's totals once, exactly like the fan-out would, so groups that
    merge rows or shipments get the same totals.  Zero total -> NULL.
    """
    totals = loaded_totals(lpn)
    j = rows.join(totals, "shipment_id", "left")
    return j.groupBy(*group_cols).agg(
        trunc_ratio_pct(F.sum("nb_loaded"), F.sum("nb_counted")).alias("percentage"))


def load_percentage_by_multiplicity(rows: DataFrame, lpn: DataFrame, group_cols: list) -> DataFrame:
    """The source's fan-out sum evaluated without pairs.

    Joining every report row to every piece of its shipment and summing per
    group gives, for each group, SUM over its shipments of k x pieces, where
    k is the number of the group's rows of that shipment.  So: count k per
    (group, shipment), join the per-shipment totals once per such pair, and
    sum k x totals per group.
    """
    mult = rows.groupBy(*group_cols, "shipment_id").agg(F.count(F.lit(1)).alias("_k"))
    j = mult.join(loaded_totals(lpn), "shipment_id", "left")
    k = F.col("_k")
    return j.groupBy(*group_cols).agg(
        trunc_ratio_pct(F.sum(k * F.col("nb_loaded")), F.sum(k * F.col("nb_counted"))).alias("percentage"))
