"""An ordered, repeatable sink for reports.

A report is written to a new folder ``<path>/versions/<id>`` and becomes the
current one when the pointer ``<path>/current.json`` is replaced, in one rename.
A job that ends in the middle leaves the pointer, and so the old report, as it
was.  Parquet keeps no order between files, so an ordered report carries its
row's place in the column ``report_order``: the rows are dealt by range and
sorted within their partition, and the place is the partition's number and the
row's number in it - no task sees all rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_COLUMN = "report_order"
_POINTER = "current.json"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The pointer of the current report; None before the first one."""
    jvm, at, fs = _file_system(spark, f"{path.rstrip('/')}/{_POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point_to(spark: SparkSession, path: str, entry: dict) -> None:
    """Replace the pointer: written beside it, then renamed over it."""
    jvm, new, fs = _file_system(spark, f"{path}/.{_POINTER}.{entry['version']}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}"), options)


def save_report(report: DataFrame, path: str, order: list[Column] | None = None) -> dict:
    """Write ``report`` as the current one of ``path`` and return its pointer.

    With ``order`` (columns that sort, like ``F.col("a").asc_nulls_last()``) the
    rows get their place in ``report_order``.  The version before stays for
    readers that still hold it; older ones go, and with them the leftovers of
    jobs that didn't end.  One writer at a time is assumed.
    """
    spark, path = report.sparkSession, path.rstrip("/")
    before = manifest(spark, path)
    version = uuid.uuid4().hex
    if order:
        report = report.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ORDER_COLUMN, F.monotonically_increasing_id())
    folder = f"{path}/versions/{version}"
    report.write.parquet(folder)
    entry = {"version": version, "ordered": bool(order), "columns": report.columns,
             "rows": spark.read.schema(report.schema).parquet(folder).count(), "before": before and before["version"]}
    _point_to(spark, path, entry)
    jvm, versions, fs = _file_system(spark, f"{path}/versions")
    for status in fs.listStatus(versions):
        if status.getPath().getName() not in (version, entry["before"]):
            fs.delete(status.getPath(), True)
    return entry


def read_report(spark: SparkSession, path: str, keep_order_column: bool = False) -> DataFrame:
    """The current report of ``path``, in its order if it was saved with one."""
    entry = manifest(spark, path)
    if entry is None:
        raise FileNotFoundError(f"no report at {path}")
    report = spark.read.parquet(f"{path.rstrip('/')}/versions/{entry['version']}")
    if not entry["ordered"]:
        return report
    report = report.orderBy(ORDER_COLUMN)
    return report if keep_order_column else report.drop(ORDER_COLUMN)
