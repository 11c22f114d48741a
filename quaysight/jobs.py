"""Batch job: compute one report and write it as parquet.

    spark-submit quaysight/jobs.py --tables s3://.../wms --report shipment_activity \\
        --as-of "2001-07-20 12:00:00" --out s3://.../reports/activity

``--tables`` holds one parquet folder per warehouse table (or use
``--database`` for metastore tables, or ``--testdata`` for the derived test
tables).  The session's ``spark.checkpoint.dir`` must name a shared folder;
the reused intermediates written there are deleted once the report is saved,
or has failed.  With ``--versioned`` the output folder keeps the report before
until the new one is whole, and the order of an ordered one; read it with
``quaysight.sinks.read_report``.  ``--rejects`` names a folder for appointments
with a malformed quantity, which end the job otherwise.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from quaysight.operators import intermediates
    from quaysight.plans import appointments, dock_doors, shipment_activity
    from quaysight.plans.dock_doors import dock_order
    from quaysight.session import tune_session
    from quaysight.sinks import save_report
    from quaysight.sources import Wms

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with one parquet folder per table")
    src.add_argument("--database", help="metastore database holding the tables")
    src.add_argument("--testdata", help="test-data folder to derive the tables from")
    p.add_argument("--report", required=True, choices=["shipment_activity", "dock_doors", "appointments"])
    p.add_argument("--as-of", help="clock of the report, 'YYYY-MM-DD HH:MM:SS' (activity, appointments)")
    p.add_argument("--out", required=True, help="output folder (parquet, overwritten)")
    p.add_argument("--versioned", action="store_true", help="swap the new report in (quaysight.sinks)")
    p.add_argument("--rejects", help="folder for rejected appointments (overwritten)")
    args = p.parse_args(argv)

    spark = tune_session(SparkSession.builder.appName(f"quaysight-{args.report}").getOrCreate())
    if args.tables:
        wms = Wms.from_parquet(spark, args.tables)
    elif args.database:
        wms = Wms.from_catalog(spark, args.database)
    else:
        wms = Wms.from_testdata(spark, args.testdata)
    if args.report != "dock_doors" and not args.as_of:
        p.error("--as-of is required for this report")
    with intermediates(spark):
        report = {
            "shipment_activity": lambda: shipment_activity(wms, args.as_of),
            "dock_doors": lambda: dock_doors(wms, ordered=not args.versioned),   # the sink orders by itself
            "appointments": lambda: appointments(wms, args.as_of, args.rejects),
        }[args.report]()
        if args.versioned:
            save_report(report, args.out, dock_order() if args.report == "dock_doors" else None)
        else:
            report.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
