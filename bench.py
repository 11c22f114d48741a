"""

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (timed runs per query after one warm-up, default 5).

1. The 27 warehouse tables are derived from the test data and staged once as
   parquet in the session's checkpoint folder (time: ``stage_seconds``;
   a few-MB table is one file, as it would be in a store) -
   the reports then read stored tables, as they do in production, with
   filter pushdown into the scans.
2. Each query is built and executed into Spark's ``noop`` sink (nothing is
   collected to the driver); one warm-up, then the median of the timed runs.

Prints ONE JSON line; ``value`` is the sum of the report medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

REPORTS = ["shipment_activity", "dock_doors", "appointments", "appointments_friday"]
OPERATORS = [
    "load_first_last", "load_first_last_selfjoin", "load_first_last_window",
    "lock_first_last", "lock_first_last_selfjoin", "lock_first_last_window",
    "piece_stage_segments", "piece_stage_segments_three_scans",
    "shipments_with_do_type", "shipments_with_do_type_distinct",
    "eav_attributes", "eav_attributes_pivot",
    "load_percentage", "load_percentage_fanout", "appointment_po_rollup", "trailer_tasks", "stop_stage_counts",
    "not_closed_list", "appointments_week", "not_closed_week",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))

    from quaysight.operators import drop_materialized
    from quaysight.plans.registry import WMS_QUERIES
    from quaysight.session import build_session, ensure_checkpoint_dir
    from quaysight.sources import Wms

    spark = build_session(cores=cpus, shuffle_partitions=max(cpus, 8), app_name="quaysight-bench")
    t0 = time.perf_counter()
    stage_root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-wms-{os.path.basename(sf_dir)}"
    w = Wms.from_testdata(spark, sf_dir).stage(stage_root)
    stage_seconds = round(time.perf_counter() - t0, 3)

    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in REPORTS + OPERATORS:
        fn = WMS_QUERIES[name]
        fn(w).write.format("noop").mode("overwrite").save()   # warm-up
        secs = []
        for _ in range(runs):
            t1 = time.perf_counter()
            fn(w).write.format("noop").mode("overwrite").save()
            secs.append(time.perf_counter() - t1)
            drop_materialized(spark)   # a refresh releases its intermediates (not timed)
        timings[name] = round(statistics.median(secs), 3)
        rows[name] = fn(w).count()
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {
        "metric": "report_seconds_total",
        "value": round(sum(timings[n] for n in REPORTS), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "stage_seconds": stage_seconds,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "config": {"master": f"local[{cpus}]", "runs": runs, "stat": "median of warm runs",
                   "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                   "aqe": spark.conf.get("spark.sql.adaptive.enabled"), "spark": spark.version},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
