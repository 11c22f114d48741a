"""SQL access: the warehouse tables and the three reports as temp views, for
users who query with ``spark.sql`` rather than the DataFrame functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quaysight.functions.clock import AsOf
from quaysight.plans.appointments import appointments
from quaysight.plans.dock_doors import dock_doors
from quaysight.plans.shipment_activity import shipment_activity
from quaysight.sources.catalog import Wms
from quaysight.sources.schemas import TABLE_NAMES


def register_views(spark: SparkSession, wms: Wms, activity_as_of: AsOf | None = None,
                   appointments_as_of: AsOf | None = None, prefix: str = "") -> list[str]:
    """Create temp views ``<prefix><table>`` for the 27 tables and, for the
    clocks given, ``<prefix>shipment_activity``, ``<prefix>dock_doors`` and
    ``<prefix>appointments``.  Returns the view names."""
    names = []
    for table in TABLE_NAMES:
        wms.table(table).createOrReplaceTempView(f"{prefix}{table}")
        names.append(f"{prefix}{table}")
    reports = {"dock_doors": lambda: dock_doors(wms)}
    if activity_as_of is not None:
        reports["shipment_activity"] = lambda: shipment_activity(wms, activity_as_of)
    if appointments_as_of is not None:
        reports["appointments"] = lambda: appointments(wms, appointments_as_of)
    for name, build in reports.items():
        build().createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names
