"""Entity-attribute-value lookups on appointment attributes.

The source query joins the attribute table once per attribute, so an attribute
stored twice for an appointment doubles the rows.  Three forms give these rows:

* ``attach_attributes_checked`` (the reports): one pass pivots the table and
  proves which appointments store an attribute once only; others are gathered,
  very large ones salted (``operators.fanout``);
* ``attach_attributes_by_joins``: the source's shape;
* ``attach_attributes``: one scan; per appointment the values of each attribute
  form a list, and one ``explode_outer`` per attribute brings back the rows,
  repeated and NULL values included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.operators.fanout import SALTED_ROWS, attach_by_joins, attach_checked

# Attribute names read by the appointment report, with the
# output column each one fills.
REPORT_ATTRIBUTES = {
    "tc_container_id": "NUM_CNT",
    "nb_pal": "NB_PALETTE",
    "nb_package": "NBR_COLIS",
    "date_arrival": "ARRIVAL_DTTM",
    "send_to_dock": "SEND_TO_DOCK",
    "cust_comments": "CUST_COMMENTS",
}


def pivot_attributes(attrs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(appointment_id, one array of ``struct(value)`` per wanted attribute);
    the struct keeps a stored NULL value apart from no value."""
    name, value = F.col("attribute_name"), F.struct(F.col("attribute_value").alias("value"))
    return (attrs.filter(name.isin(*wanted.values())).groupBy("appointment_id")
            .agg(*[F.collect_list(F.when(name == n, value)).alias(a) for a, n in wanted.items()]))


def attach_attributes(df: DataFrame, attrs: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """LEFT JOIN of every wanted attribute (alias -> attribute name) on
    appointment_id, in one pass over ``attrs``."""
    wanted = wanted or REPORT_ATTRIBUTES
    out = df.join(pivot_attributes(attrs, wanted), "appointment_id", "left")
    for alias in wanted:
        out = out.withColumn(alias, F.explode_outer(alias)).withColumn(alias, F.col(f"{alias}.value"))
    return out


def _tall(attrs: DataFrame) -> DataFrame:
    return attrs.select("appointment_id", F.col("attribute_name").alias("tag"), F.col("attribute_value").alias("value"))


def attach_attributes_checked(df: DataFrame, attrs: DataFrame, wanted: dict[str, str] | None = None,
                              salted_rows: int = SALTED_ROWS) -> DataFrame:
    """LEFT JOIN of every wanted attribute by a checked pivot."""
    return attach_checked(df, _tall(attrs), "appointment_id", wanted or REPORT_ATTRIBUTES, "attributes", salted_rows)


def attach_attributes_by_joins(df: DataFrame, attrs: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """One filtered LEFT JOIN per wanted attribute."""
    return attach_by_joins(df, _tall(attrs), "appointment_id", wanted or REPORT_ATTRIBUTES)
