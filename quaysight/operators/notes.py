"""Tagged free-text notes.

Shipment notes carry a one-character tag in front of the text ('#' detour,
'$' users, '@' order / co-loading, '+' addition).  Purchase-order notes start
with a two-character priority code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaysight.functions.semantics import empty_as_null, ora_substr
from quaysight.operators.fanout import SALTED_ROWS, attach_checked

# Shipment note tags.
TAG_DETOUR = "#"
TAG_USERS = "$"
TAG_ORDER = "@"
TAG_ADDITION = "+"
NOTE_BODY_LENGTH = 499

# Purchase-order note prefix -> priority (1 = most urgent);
# anything else, NULL included, is 8.
PO_PRIORITY_CODES = (("PU", 1), ("CU", 2), ("WU", 3), ("P0", 4), ("C0", 5), ("W0", 6), ("UR", 7))
PO_PRIORITY_DEFAULT = 8


def tagged_notes(shipment_note: DataFrame) -> DataFrame:
    """(shipment_id, tag, body): tag = first character, body = characters
    2..500 ('' -> NULL, so a bare tag has a NULL body)."""
    note = F.col("note")
    return shipment_note.select(
        "shipment_id", empty_as_null(F.substring(note, 1, 1)).alias("tag"),
        ora_substr(note, 2, NOTE_BODY_LENGTH).alias("body"))


def attach_notes(df: DataFrame, shipment_note: DataFrame, tags: dict[str, str],
                 key: str = "shipment_id") -> DataFrame:
    """LEFT JOIN of one note set per tag (alias -> tag) in one pass over the
    notes: per shipment the bodies of each tag form a list, exploded again, so
    several notes of one tag multiply the rows as the joins would."""
    tag, body = F.col("tag"), F.struct("body")
    lists = (tagged_notes(shipment_note).filter(tag.isin(*tags.values())).groupBy("shipment_id")
             .agg(*[F.collect_list(F.when(tag == t, body)).alias(a) for a, t in tags.items()]))
    out = df.join(lists.withColumnRenamed("shipment_id", key), key, "left")
    for alias in tags:
        out = out.withColumn(alias, F.explode_outer(alias)).withColumn(alias, F.col(f"{alias}.body"))
    return out


def attach_notes_checked(df: DataFrame, shipment_note: DataFrame, tags: dict[str, str],
                         key: str = "shipment_id", salted_rows: int = SALTED_ROWS) -> DataFrame:
    """The rows of ``attach_notes`` by a checked pivot: only shipments that
    repeat a tag are gathered, and one with very many notes is salted
    (``operators.fanout``)."""
    tall = tagged_notes(shipment_note).select(F.col("shipment_id").alias(key), "tag", F.col("body").alias("value"))
    return attach_checked(df, tall, key, tags, "notes", salted_rows)


def po_priority(note) -> F.Column:
    """CASE SUBSTR(note,1,2) WHEN 'PU' THEN 1 ... ELSE 8 END."""
    code = ora_substr(note, 1, 2)
    out = None
    for prefix, rank in PO_PRIORITY_CODES:
        out = F.when(code == prefix, F.lit(rank)) if out is None else out.when(code == prefix, F.lit(rank))
    return out.otherwise(F.lit(PO_PRIORITY_DEFAULT))
