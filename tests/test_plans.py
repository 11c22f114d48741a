"""Plan shape: what the physical plans must (not) contain.

* no Python evaluation in the reports and their operators (all of them are Catalyst expressions);
* no Cartesian product; the only nested-loop join is the one-row broadcast
  of the not-closed list in the activity report;
* on stored (parquet) tables the clock windows and status bands reach the
  scans as pushed filters, and scans read only the columns they need.
"""

import re

import pytest

from quaysight.plans.registry import QUERIES as REPORT_QUERIES
from tests.conftest import SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                "MapInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", list(REPORT_QUERIES))
def test_no_python_and_no_cartesian(spark, key):
    plan = plan_of(REPORT_QUERIES[key](spark, SMALL))
    assert not any(node in plan for node in PYTHON_NODES), key
    assert "CartesianProduct" not in plan
    if key != "shipment_activity":
        assert "BroadcastNestedLoopJoin" not in plan, key


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    from quaysight.sources import Wms

    root = str(tmp_path_factory.mktemp("wms"))
    return Wms.from_testdata(spark, SMALL).stage(root)


def _scan_lines(plan: str, table: str) -> list[str]:
    return [ln for ln in plan.splitlines() if "FileScan parquet" in ln and f"/{table}]" in ln]


def test_activity_pushes_clock_and_status_into_scan(staged):
    """The activity report's driving set (written before anything else) reads
    ``shipment`` with the status band and both clock windows pushed down."""
    from quaysight.plans.shipment_activity import watched_shipments

    plan = plan_of(watched_shipments(staged, "2001-07-20 12:00:00"))
    scans = _scan_lines(plan, "shipment")
    assert scans, plan[:2000]
    assert any("shipment_status" in s and "pickup_start_dttm" in s and "PushedFilters" in s for s in scans)


def test_appointments_push_window_into_scan(staged):
    """The appointment report's driving set reads ``ilm_appointments`` with
    the business-day window pushed down."""
    from quaysight.functions import business_day_window

    plan = plan_of(staged.ilm_appointments.filter(business_day_window("scheduled_dttm", "2024-01-12 12:00:00")))
    scans = _scan_lines(plan, "ilm_appointments")
    assert scans and all(re.search(r"PushedFilters: \[[^\]]*scheduled_dttm", s) for s in scans)


def test_scans_read_only_needed_columns(spark, staged):
    from quaysight.plans.dock_doors import open_shipment_keys, tagged_pieces

    plan = plan_of(tagged_pieces(staged.lpn, open_shipment_keys(staged)))
    scans = _scan_lines(plan, "lpn")
    assert len(scans) == 1
    for s in scans:
        columns = re.search(r"FileScan parquet \[([^\]]*)\]", s).group(1)
        assert "order_id" not in columns and "lpn_id" not in columns, columns


# Reads each report once in a session of its own and counts, over all its jobs,
# the scans of each table in Spark's event log.
SCANS_OF_ALL_JOBS = """
import collections, glob, json, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", {log!r}).config("spark.eventLog.compress", "false")
         .config("spark.eventLog.rolling.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
from quaysight.plans import appointments, dock_doors, shipment_activity
from quaysight.session import tune_session
from quaysight.sources import Wms
tune_session(spark)
w = Wms.from_parquet(spark, {tables!r})
report = {{"dock_doors": lambda: dock_doors(w), "appointments": lambda: appointments(w, "2024-01-12 12:00:00"),
          "shipment_activity": lambda: shipment_activity(w, "2001-07-20 12:00:00")}}[{report!r}]()
report.write.format("noop").mode("overwrite").save()
spark.stop()
plans = {{}}
for path in glob.glob({log!r} + "/*"):
    for line in open(path):
        event = json.loads(line)
        if "sparkPlanInfo" in event:   # the start of an execution, then its plan as it is changed at run time
            plans[event["executionId"]] = event["sparkPlanInfo"]
found = collections.Counter()
def walk(node):
    if node["nodeName"].startswith("Scan parquet"):
        found[node["metadata"].get("Location", "").rstrip("]").rsplit("/", 1)[-1]] += 1
    for child in node["children"]:
        walk(child)
for plan in plans.values():
    walk(plan)
print("FOUND", json.dumps(found))
"""


@pytest.mark.parametrize("report,large", [
    ("dock_doors", ("lpn", "shipment_note")),
    ("appointments", ("ilm_appt_custom_attribute", "ilm_appointment_objects", "trailer_visit", "trailer_visit_detail", "ilm_tasks")),
    ("shipment_activity", ("lpn", "prod_trkg_tran", "lpn_lock", "shipment_note", "do_orders")),
])
def test_large_tables_read_once_over_all_jobs(staged, tmp_path, report, large):
    import json
    import os
    import subprocess
    import sys

    from tests.conftest import ROOT

    tables = staged.lpn.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 2)[0]
    (tmp_path / "log").mkdir()
    script = SCANS_OF_ALL_JOBS.format(root=ROOT, log=str(tmp_path / "log"), tables=tables, report=report)
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300,
                         env=os.environ | {"TMPDIR": str(tmp_path)})
    lines = [x for x in run.stdout.splitlines() if x.startswith("FOUND ")]
    assert lines, run.stderr[-2000:]
    found = json.loads(lines[0][6:])
    assert {t: found.get(t, 0) for t in large} == dict.fromkeys(large, 1)


ROBUST_KEYS = ["shipment_activity", "dock_doors", "appointments_friday", "load_first_last", "lock_first_last",
               "trailer_tasks", "appointment_po_rollup", "piece_stage_segments", "not_closed_list"]


def test_same_rows_without_broadcast_or_aqe(spark, duck_small):
    """Sort-merge joins only, no runtime re-planning, other partition count:
    the results must not depend on the physical strategy."""
    from oracle.queries import oracle_queries
    from quaysight.plans.registry import QUERIES
    from tests.compare import compare

    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                           "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        sql = oracle_queries()
        for key in ROBUST_KEYS:
            df = QUERIES[key](spark, SMALL)
            plan = plan_of(df)
            assert "AdaptiveSparkPlan" not in plan
            res = compare(df, duck_small, sql[key])
            assert res["match"], (key, res)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("report,as_of,limits", [
    ("shipment_activity", "2001-07-20 12:00:00",
     {"lpn": 0, "prod_trkg_tran": 1, "lpn_lock": 1, "shipment_note": 1, "do_orders": 0}),
    ("dock_doors", None, {"lpn": 1, "shipment_note": 0}),
    ("appointments", "2024-01-12 12:00:00",
     {"ilm_appt_custom_attribute": 0, "ilm_appointment_objects": 0, "trailer_visit": 0, "ilm_tasks": 1}),
])
def test_large_tables_read_at_most_once(staged, report, as_of, limits):
    """The big tables are read in the jobs that write the reused cut inputs;
    the report's own plan reads them at most ``limits`` times."""
    from quaysight import plans

    fn = getattr(plans, report)
    df = fn(staged, as_of) if as_of else fn(staged)
    plan = plan_of(df)
    for table, most in limits.items():
        assert len(_scan_lines(plan, table)) <= most, (report, table)


def test_written_driving_set_is_broadcast_at_plan_time(spark, staged):
    """With AQE off (no runtime help), cutting ``lpn`` by the written driving
    set plans a broadcast semi join that streams ``lpn``: no shuffle of it."""
    from quaysight.operators import materialize, restrict_to
    from quaysight.plans.shipment_activity import watched_shipments

    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        watched = materialize(watched_shipments(staged, "2001-07-20 12:00:00"), "watched")
        plan = plan_of(restrict_to(staged.lpn, watched, "shipment_id"))
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan, plan
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
