"""Run every named query against its oracle:  python tests/run_compare.py [sf_dir] [key ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from quaysight.session import build_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(queries())
    spark = build_session(shuffle_partitions=8)
    con = duck(sf_dir)
    q, o = queries(), oracle_sql()
    bad = 0
    for k in keys:
        t = time.time()
        try:
            res = compare(q[k](spark, sf_dir), con, o[k]) if k in o else {"match": None}
        except Exception as exc:  # report and continue
            res = {"match": False, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += res.get("match") is not True
        print(f"{k:36s} {'OK ' if res.get('match') else 'BAD'} {time.time() - t:6.1f}s {res}", flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
