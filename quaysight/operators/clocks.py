"""Windows of many clocks in one scan.

With one literal clock a window folds to constants and is pushed into the scan.
With many, each clock's window is an interval of days.  The clock table is
spread to one row per (clock, day), and the rows meet it by equality on their
day - a point-in-interval join by day buckets, not a comparison of every row
with every clock.  An interval open at its end is spread up to the day after
the last bound of any clock; rows of that day or later share this last bucket,
as no bound tells them apart.

On tables stored by day (``Wms.stage(by_day=True)``) the bucket is computed from
the partition column, so that Spark's dynamic partition pruning reads the days
of the clocks only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysight.functions.clock import AsOf, as_of_col, between_midnights, business_days_ahead
from quaysight.operators.lists import lists_in_parts
from quaysight.operators.shipments import NOT_CLOSED_FROM_DAYS, NOT_CLOSED_TO_DAYS, OPEN_DAYS_BACK, in_progress
from quaysight.sources.schemas import DAY_PARTITION


def clock_table(spark: SparkSession, clocks: Iterable[AsOf]) -> DataFrame:
    """(as_of): the distinct clocks, a list that the caller gives."""
    given = [as_of_col(c) for c in clocks]
    none = F.array().cast("array<timestamp_ntz>")
    # from a range of one row, so that Spark knows how small the table is
    return spark.range(1).select(F.explode(F.array(*given) if given else none).alias("as_of")).distinct()


def _windows(clocks: DataFrame, first: Column, last: Column) -> DataFrame:
    return clocks.select("as_of", first.alias("_first"), last.cast("date").alias("_last"))


def business_windows(clocks: DataFrame) -> DataFrame:
    """From each clock's day to its next working day."""
    today = F.to_date("as_of")
    return _windows(clocks, today, F.date_add(today, business_days_ahead(today)))


def open_windows(clocks: DataFrame, days_back: int) -> DataFrame:
    """All days after the day ``days_back`` before each clock."""
    return _windows(clocks, F.date_sub(F.to_date("as_of"), days_back - 1), F.lit(None))


def past_windows(clocks: DataFrame, from_days_back: int, to_days_back: int) -> DataFrame:
    today = F.to_date("as_of")
    return _windows(clocks, F.date_sub(today, from_days_back), F.date_sub(today, to_days_back))


def rows_in_windows(rows: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """(as_of, columns of ``rows``): each row once for every clock whose window
    holds its day.  A row without a time is in no window."""
    cap = windows.agg(F.max(F.greatest("_first", F.coalesce("_last", "_first")))).first()[0]   # one date
    last = F.date_add(F.lit(cap).cast("date"), 1)
    spread = windows.select("as_of", "_first", F.explode(F.sequence("_first", F.coalesce("_last", last))).alias("_bucket"))
    spread = spread.filter(F.col("_bucket") >= F.col("_first")).drop("_first")
    columns = [c for c in rows.columns if c != DAY_PARTITION]
    day = F.col(DAY_PARTITION) if DAY_PARTITION in rows.columns else F.to_date(ts)
    return rows.join(spread, F.least(day, last) == F.col("_bucket")).filter(F.col(ts).isNotNull()).select("as_of", *columns)


def active_shipments_by_clock(shipment: DataFrame, clocks: DataFrame, days_back: int = OPEN_DAYS_BACK) -> DataFrame:
    """``active_shipments`` of each clock."""
    return rows_in_windows(in_progress(shipment), "pickup_start_dttm", open_windows(clocks, days_back))


def not_closed_by_clock(shipment: DataFrame, lpn: DataFrame, clocks: DataFrame, from_days: int = NOT_CLOSED_FROM_DAYS,
                        to_days: int = NOT_CLOSED_TO_DAYS) -> DataFrame:
    """(as_of, not_closed): ``not_closed_list`` of each clock, NULL when it has none."""
    late = rows_in_windows(in_progress(shipment), "pickup_start_dttm", past_windows(clocks, from_days, to_days))
    late = late.filter(between_midnights("pickup_start_dttm", F.col("as_of"), from_days, to_days)).select(
        "as_of", "shipment_id", "tc_shipment_id")
    with_pieces = lpn.select("shipment_id").join(late.select("shipment_id"), "shipment_id", "left_semi")
    found = lists_in_parts(late.join(with_pieces, "shipment_id", "left_semi"), ["as_of"], "tc_shipment_id", "not_closed")
    return clocks.join(found, "as_of", "left")
