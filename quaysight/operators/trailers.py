"""Trailer timeline of an appointment's visit.

Per (appointment, trailer type, seal, check-in, check-out, yard location,
trailer): the first task created for the trailer at or after check-in and the
last task update after it (NULL when it equals that first creation).

Plan: the timeline only depends on (trailer_id, checkin_dttm), so it is
computed once per distinct (trailer, check-in) and joined back to the visit
rows.  The source's equi + range join (same trailer, ``checkin <= created``)
would pair every check-in with every later task of the trailer; instead
``task_spans`` runs a suffix MIN/MAX in two levels over the trailer's time line,
cut into slices and these into ranges, in one pass over the task log (no pairs,
and a busy trailer is split across tasks at every step).  A NULL
check-in or trailer finds no task, as in the source query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaysight.operators import materialize

TIMELINE_KEYS = ("appointment_id", "type", "seal_number", "checkin_dttm", "checkout_dttm",
                 "dsp_locn", "trailer_id")


def visit_rows(detail: DataFrame, visit: DataFrame, trailer_ref: DataFrame, locn_hdr: DataFrame) -> DataFrame:
    d = detail.select("appointment_id", "visit_id", "type", "seal_number")
    v = visit.select(F.col("visit_id").alias("_v_visit_id"), "trailer_id", "checkin_dttm", "checkout_dttm")
    r = trailer_ref.select("active_visit_id", "current_location_id")
    loc = locn_hdr.select("locn_id", "dsp_locn")
    return (d.join(v, d.visit_id == v._v_visit_id, "left")
            .join(r, F.col("_v_visit_id") == r.active_visit_id, "left")
            .join(loc, F.col("current_location_id") == loc.locn_id, "left"))


def task_spans(spans: DataFrame, tasks: DataFrame, bucket: str = "hour", stretch: str = "month") -> DataFrame:
    """(trailer_id, checkin_dttm, min_task, _max_update) for the distinct spans:
    MIN(created) and MAX(last_updated) over the trailer's tasks created at or
    after check-in - computed without pairs, in one pass over the task log.

    Per trailer the tasks form a time line.  It is cut into ``bucket`` slices
    (an hour) and these into ``stretch`` ranges (a month), so that no step
    holds a trailer whole, be it one with a third of all tasks and check-ins:

    1. tasks and check-ins of one (trailer, slice), latest first (tasks before
       check-ins on a tie, since ``checkin <= created`` admits equal times): a
       running MIN/MAX gives each check-in the part of its answer from its own
       slice, and each slice leaves one row with its MIN/MAX.  Both are written
       once: the check-ins, and far fewer slices than tasks;
    2. the suffix over a trailer's later slices, one row per slice, within each
       (trailer, range);
    3. the carry of a trailer's later ranges, one row per range, joined to the
       slices on (trailer, range);
    4. the slices joined back to the check-ins on (trailer, slice).
    """
    kept = materialize(slice_timeline(spans, tasks, bucket), "timeline")
    ahead = slices_ahead(kept.filter("_leads").select("trailer_id", "_slice", "_slice_min", "_slice_max"), stretch)
    return kept.filter("_kind = 1").join(ahead, ["trailer_id", "_slice"]).select(
        "trailer_id", "checkin_dttm",
        F.least("_local_min", "_ahead_min").alias("min_task"),
        F.greatest("_local_max", "_ahead_max").alias("_max_update"))


def slice_timeline(spans: DataFrame, tasks: DataFrame, bucket: str) -> DataFrame:
    """Step 1: the check-ins (``_kind`` 1) with the MIN/MAX of their own slice
    from check-in on, and the latest row of each slice (``_leads``) with the
    MIN/MAX of the whole slice."""
    t, kind = F.col("_t"), F.col("_kind")
    # tasks without a trailer or a creation time match no check-in; tasks
    # created at one moment count once
    points = (tasks.filter(F.col("trailer_id").isNotNull() & F.col("created_dttm").isNotNull())
              .groupBy("trailer_id", "created_dttm").agg(F.max("last_updated_dttm").alias("last_updated_dttm")))
    none = F.lit(None).cast("timestamp_ntz")
    task_rows = points.select("trailer_id", F.col("created_dttm").alias("_t"), F.lit(0).alias("_kind"), "created_dttm", "last_updated_dttm")
    span_rows = spans.select("trailer_id", F.col("checkin_dttm").alias("_t"), F.lit(1).alias("_kind"),
                             none.alias("created_dttm"), none.alias("last_updated_dttm"))
    rows = task_rows.unionByName(span_rows).withColumn("_slice", F.date_trunc(bucket, t))

    in_slice = Window.partitionBy("trailer_id", "_slice").orderBy(t.desc(), kind.asc())
    running = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("trailer_id", "_slice")
    scored = rows.select(
        "trailer_id", "_slice", "_kind", t.alias("checkin_dttm"),
        F.min("created_dttm").over(running).alias("_local_min"),
        F.max("last_updated_dttm").over(running).alias("_local_max"),
        F.min("created_dttm").over(whole).alias("_slice_min"),
        F.max("last_updated_dttm").over(whole).alias("_slice_max"),
        (F.row_number().over(in_slice) == 1).alias("_leads"))
    return scored.filter((kind == 1) | F.col("_leads"))


def slices_ahead(slices: DataFrame, stretch: str) -> DataFrame:
    """Steps 2 and 3: per (trailer, slice) the MIN/MAX of its later slices."""
    slices = slices.withColumn("_range", F.date_trunc(stretch, "_slice"))
    later = Window.partitionBy("trailer_id", "_range").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = slices.select("trailer_id", "_slice", "_range",
                           F.min("_slice_min").over(later).alias("_after_min"), F.max("_slice_max").over(later).alias("_after_max"))
    beyond = Window.partitionBy("trailer_id").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = (slices.groupBy("trailer_id", "_range").agg(F.min("_slice_min").alias("_min"), F.max("_slice_max").alias("_max"))
               .select("trailer_id", "_range", F.min("_min").over(beyond).alias("_carry_min"), F.max("_max").over(beyond).alias("_carry_max")))
    return suffix.join(carries, ["trailer_id", "_range"]).select(
        "trailer_id", "_slice", F.least("_after_min", "_carry_min").alias("_ahead_min"),
        F.greatest("_after_max", "_carry_max").alias("_ahead_max"))


def trailer_tasks(detail: DataFrame, visit: DataFrame, trailer_ref: DataFrame,
                  locn_hdr: DataFrame, tasks: DataFrame, spans_fn=task_spans) -> DataFrame:
    groups = visit_rows(detail, visit, trailer_ref, locn_hdr).select(*TIMELINE_KEYS).distinct()
    spans = (groups.select("trailer_id", "checkin_dttm")
             .filter(F.col("trailer_id").isNotNull() & F.col("checkin_dttm").isNotNull()).distinct())
    timeline = spans_fn(spans, tasks)
    out = groups.join(timeline, ["trailer_id", "checkin_dttm"], "left")
    return out.select(*TIMELINE_KEYS, "min_task",
                      F.nullif(F.col("_max_update"), F.col("min_task")).alias("max_task"))
