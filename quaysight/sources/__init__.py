"""Sources: table schemas and the ``Wms`` table set."""

from quaysight.sources.catalog import Wms
from quaysight.sources.schemas import SCHEMAS, TABLE_NAMES

__all__ = ["Wms", "SCHEMAS", "TABLE_NAMES"]
