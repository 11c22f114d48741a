"""Piece stages: classify each piece (LPN) as prepared, staged or loaded,
count them per shipment (or per shipment and destination), split by
mechanised / traditional container, and express the counts as shares.

Scale notes
-----------
* Classification is a projection over ``lpn`` left-joined to the location
  master ``locn_hdr`` (a bounded dimension: Spark's size check broadcasts it).
* All segment counts come from ONE scan and ONE aggregation with conditional
  sums (partial aggregation on the map side, so a hot shipment collapses to a
  row per task before the shuffle).  ``stage_segments_three_scans`` keeps the
  source shape (three aggregations joined) for the equivalence test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.functions.semantics import flag, round_share, share_string
from quaysight.operators import left_join_dealt

# Container types handled by the mechanised line.
MECA_CONTAINER_TYPES = ("03", "05", "06", "PTS")
STAGED_CLASS = "S"


@dataclass(frozen=True)
class StageRule:
    """Thresholds of the classifier; two variants exist in the reports."""

    prep_classes: tuple[str, ...]
    loaded_status: int = 50
    loaded_exact: bool = False   # True: status = 50; False: status >= 50


# The two classifier variants.
ACTIVITY_RULE = StageRule(prep_classes=("R", "P"), loaded_status=50, loaded_exact=False)
DOCK_RULE = StageRule(prep_classes=("R",), loaded_status=50, loaded_exact=True)

SEGMENTS = ("global", "meca", "tradi")


def stage_flags(status: Column, locn_class: Column, rule: StageRule) -> dict[str, Column]:
    """0/1 flags prep / ancr (staged) / chgt (loaded).

    A status in 20..30 whose location class is neither a prep class, NULL nor
    'S' falls in no stage; so does a NULL status (no ELSE bucket).
    """
    band = status.between(20, 30)
    prep = (status < 20) | (band & (locn_class.isin(*rule.prep_classes) | locn_class.isNull()))
    ancr = (band & (locn_class == STAGED_CLASS)) | status.between(31, 49)
    chgt = (status == rule.loaded_status) if rule.loaded_exact else (status >= rule.loaded_status)
    return {"prep": flag(prep), "ancr": flag(ancr), "chgt": flag(chgt)}


def segment_predicate(segment: str, container_type: Column) -> Column:
    """global: every piece; meca: container in the set; tradi: the rest,
    NULL container included (three-valued safe complement)."""
    if segment == "global":
        return F.lit(True)
    meca = container_type.isin(*MECA_CONTAINER_TYPES)
    if segment == "meca":
        return meca
    if segment == "tradi":
        return (~meca) | container_type.isNull()
    raise ValueError(f"unknown segment {segment!r}")


def classified_pieces(lpn: DataFrame, locn_hdr: DataFrame, rule: StageRule,
                      keys: tuple[str, ...] = ("shipment_id",)) -> DataFrame:
    """One row per piece with a shipment: keys, container_type, prep, ancr, chgt."""
    pieces = lpn.filter(F.col("shipment_id").isNotNull()).select(
        *keys, "container_type", "curr_sub_locn_id", "lpn_facility_status")
    loc = locn_hdr.select(F.col("locn_id"), F.col("locn_class"))
    joined = left_join_dealt(pieces, loc, "curr_sub_locn_id", "locn_id", [*keys, "lpn_facility_status"])
    flags = stage_flags(F.col("lpn_facility_status"), F.col("locn_class"), rule)
    return joined.select(*keys, "container_type", *[c.alias(n) for n, c in flags.items()])


def stage_counts(pieces: DataFrame, keys: tuple[str, ...] = ("shipment_id",),
                 segment: str = "global") -> DataFrame:
    """SUM of each flag and COUNT(*) per key over one segment's pieces."""
    rows = pieces.filter(segment_predicate(segment, F.col("container_type")))
    return rows.groupBy(*keys).agg(
        F.sum("prep").alias("nb_prep"), F.sum("ancr").alias("nb_ancr"),
        F.sum("chgt").alias("nb_chgt"), F.count(F.lit(1)).alias("nb_pieces"))


def share_columns(prefix: str = "") -> list[Column]:
    """Integer shares prep/ancr/chgt (ROUND(SUM*100/COUNT(*))) and the progress
    string 'ppp / aaa / ccc' of the counts ``{prefix}nb_*``."""
    n = F.col(f"{prefix}nb_pieces")
    shares = [round_share(F.col(f"{prefix}nb_{s}"), n) for s in ("prep", "ancr", "chgt")]
    return ([c.alias(f"{prefix}{s}") for c, s in zip(shares, ("prep", "ancr", "chgt"))]
            + [share_string(*shares).alias(f"{prefix}advancement")])


def with_shares(counts: DataFrame, prefix: str = "") -> DataFrame:
    """``counts`` plus its shares and progress string (one projection)."""
    return counts.select("*", *share_columns(prefix))


def segment_aggregates(segments: tuple[str, ...]) -> list[Column]:
    """Conditional sums for several segments in one aggregation."""
    aggs: list[Column] = []
    for seg in segments:
        inside = segment_predicate(seg, F.col("container_type"))
        aggs.append(F.sum(flag(inside)).alias(f"{seg}_nb_pieces"))
        for s in ("prep", "ancr", "chgt"):
            aggs.append(F.sum(F.when(inside, F.col(s)).otherwise(F.lit(0))).alias(f"{seg}_nb_{s}"))
    return aggs


def stage_segments(pieces: DataFrame, keys: tuple[str, ...] = ("shipment_id",),
                   segments: tuple[str, ...] = SEGMENTS, shares: bool = True) -> DataFrame:
    """Counts (and shares) of every segment in one pass over the pieces.

    Grain: keys having at least one piece.  Columns per segment:
    ``{seg}_nb_prep/_nb_ancr/_nb_chgt/_nb_pieces`` and with ``shares``
    ``{seg}_prep/_ancr/_chgt/_advancement``.  A segment without any piece
    reads as NULL (as a LEFT JOIN to a missing group would), not as zero.
    """
    counts = pieces.groupBy(*keys).agg(*segment_aggregates(segments))
    cols: list[Column] = [F.col(k) for k in keys]
    for seg in segments:
        n = F.col(f"{seg}_nb_pieces")
        seg_cols = [F.col(f"{seg}_nb_{s}").alias(f"{seg}_nb_{s}") for s in ("prep", "ancr", "chgt")]
        if shares:
            seg_cols += share_columns(f"{seg}_")
        if seg != "global":
            seg_cols = [F.when(n > 0, c) for c in seg_cols]
        cols += [c.alias(name) for c, name in zip(seg_cols, _names(seg, shares))] + [n]
    return counts.select(*cols)


def _names(seg: str, shares: bool) -> list[str]:
    names = [f"{seg}_nb_{s}" for s in ("prep", "ancr", "chgt")]
    if shares:
        names += [f"{seg}_{s}" for s in ("prep", "ancr", "chgt", "advancement")]
    return names


def stage_segments_three_scans(pieces: DataFrame, keys: tuple[str, ...] = ("shipment_id",),
                               segments: tuple[str, ...] = SEGMENTS, shares: bool = True) -> DataFrame:
    """Source shape: one aggregation per segment, LEFT JOINed on the keys to
    the first segment.  Same rows as ``stage_segments``; kept for testing."""
    out = None
    for seg in segments:
        counts = stage_counts(pieces, keys, seg)
        if shares:
            counts = with_shares(counts)
        renamed = counts.select(*keys, *[F.col(c).alias(f"{seg}_{c}") for c in counts.columns if c not in keys])
        out = renamed if out is None else out.join(renamed, list(keys), "left")
    return out
