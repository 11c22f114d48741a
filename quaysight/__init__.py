"""quaysight: warehouse and dock-operations reports as Spark DataFrames.

Three reports (outbound shipment activity, dock doors, inbound appointments)
are composed from small DataFrame -> DataFrame operators.  Every operator is
built from Spark's own column expressions, joins, aggregates and windows, so
the whole plan stays inside Catalyst / whole-stage codegen; there is no Python
UDF anywhere in the package.

Layout
------
``sources``    table schemas and the ``Wms`` table set (parquet, catalog, or the
               test-data derivation).
``functions``  column expressions with the source system's scalar semantics
               (empty string is NULL, NULL-tolerant concatenation, half-up
               rounding, truncated ratios, date masks, business-day windows).
``operators``  reusable relational steps (stage classification, first/last
               events with ties, tagged notes, attribute lookups, PO rollups,
               trailer timelines).
``plans``      the three reports and the registry of named queries.
``llm``        operators for training data (optional; nothing else imports it).
"""

from quaysight.session import build_session

__all__ = ["build_session"]
