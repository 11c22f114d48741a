"""Pair-emitting forms of the source queries, for small fixtures only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.functions.semantics import flag, trunc_ratio_pct
from quaysight.operators.dock import COUNTED_STATUS_MAX, LOADED_STATUS
from quaysight.plans.dock_doors import DOCK_COLUMNS, GROUP_COLUMNS, dock_rows
from quaysight.sources.catalog import Wms


def load_percentage_fanout(rows: DataFrame, lpn: DataFrame, group_cols: list) -> DataFrame:
    """Every report row LEFT JOINed to every piece of its shipment."""
    status = F.col("lpn_facility_status")
    pieces = lpn.filter(F.col("shipment_id").isNotNull()).select(
        "shipment_id", flag(status == LOADED_STATUS).alias("chgt"),
        flag(status <= COUNTED_STATUS_MAX).alias("total"))
    j = rows.join(pieces, "shipment_id", "left")
    return j.groupBy(*group_cols).agg(trunc_ratio_pct(F.sum("chgt"), F.sum("total")).alias("percentage"))


def dock_doors_fanout(w: Wms) -> DataFrame:
    return load_percentage_fanout(dock_rows(w), w.lpn, GROUP_COLUMNS).select(*DOCK_COLUMNS)


def task_spans_range_join(spans: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every check-in paired with every later task of its trailer."""
    t = tasks.select(F.col("trailer_id").alias("_t_trailer"), "created_dttm", "last_updated_dttm")
    j = spans.join(t, (spans.trailer_id == t._t_trailer) & (spans.checkin_dttm <= t.created_dttm), "inner")
    return j.groupBy("trailer_id", "checkin_dttm").agg(
        F.min("created_dttm").alias("min_task"), F.max("last_updated_dttm").alias("_max_update"))
