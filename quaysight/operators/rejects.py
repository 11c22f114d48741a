"""Rows whose text can't be cast: kept apart instead of ending the job.

By default the reports cast strictly, as the source does: one malformed
quantity raises.  ``split_rejects`` makes the same casts with ``try_cast``,
writes the rows once with the reason of the first text that failed, and reads
the good rows and the rejects from that table.  How many rows there are of each
is observed while it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quaysight.functions.semantics import empty_as_null
from quaysight.operators import materialize

REASON = "reject_reason"
# Numbers that a cast is tried with first: what fails here is no number at all.
_WIDEST = "decimal(38,10)"
# The casts of the appointment report's quantities.
QUANTITY_TYPES = {"nb_pal": "decimal(10,3)", "nb_package": "decimal(10,3)"}


@dataclass(frozen=True)
class Split:
    good: DataFrame       # columns of the rows
    rejected: DataFrame   # the same and ``reject_reason``
    rows: int
    rejects: int


def cast_reason(column: str, dtype: str) -> Column:
    """Why the text of ``column`` is no ``dtype``; NULL if it is one, or NULL or ''."""
    text = empty_as_null(F.col(column))
    return (F.when(text.isNull() | text.try_cast(dtype).isNotNull(), F.lit(None))
            .when(text.try_cast(_WIDEST).isNull(), F.lit(f"{column}: not a number"))
            .otherwise(F.lit(f"{column}: out of range of {dtype}")))


def split_rejects(rows: DataFrame, types: dict[str, str], name: str = "checked") -> Split:
    """The rows whose columns can all be cast to ``types`` (column -> type),
    and the others with their reason, in one pass."""
    seen = Observation()
    reason = F.coalesce(*[cast_reason(c, t) for c, t in types.items()])
    written = materialize(rows.withColumn(REASON, reason).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(REASON)).alias("rejects")), name)
    found = seen.get
    return Split(written.filter(F.col(REASON).isNull()).drop(REASON), written.filter(F.col(REASON).isNotNull()),
                 found["rows"], found["rejects"])


def split_attributes(attrs: DataFrame, quantities: tuple[str, ...], dtype: str = "decimal(10,3)") -> Split:
    """The values of the named attributes, split: ``good`` are the ones that
    are a ``dtype``."""
    return split_rejects(attrs.filter(F.col("attribute_name").isin(*quantities)), {"attribute_value": dtype}, "quantities")
