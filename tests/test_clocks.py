"""Many clocks in one run, and tables stored by day."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaysight.operators.clocks import (
    active_shipments_by_clock,
    business_windows,
    clock_table,
    not_closed_by_clock,
    open_windows,
    past_windows,
    rows_in_windows,
)
from quaysight.operators.shipments import active_shipments, not_closed_list
from quaysight.plans import appointments, appointments_by_clock, shipment_activity
from quaysight.plans.appointments import window_appointments
from quaysight.plans.registry import ACTIVITY_WEEK, APPOINTMENT_WEEK
from quaysight.plans.shipment_activity import watched_shipments
from quaysight.sources import Wms
from quaysight.sources.schemas import DAY_PARTITION
from tests.conftest import SMALL
from tests.test_plans import plan_of


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    return Wms.from_testdata(spark, SMALL).stage(str(tmp_path_factory.mktemp("flat")))


@pytest.fixture(scope="module")
def by_day(flat, tmp_path_factory):
    return flat.stage(str(tmp_path_factory.mktemp("days")), by_day=True)


def rows(df):
    return Counter(map(tuple, df.collect()))


def each(fn, clocks):
    out = Counter()
    for c in clocks:
        for r, n in rows(fn(c)).items():
            out[(dt.datetime.fromisoformat(c), *r)] += n
    return out


def test_windows_of_random_clocks(spark):
    """Each row meets exactly the clocks whose interval of days holds it."""
    rnd = random.Random(2)
    start = dt.datetime(2024, 2, 25)
    times = [(i, None if rnd.random() < 0.1 else start + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20))) for i in range(300)]
    times += [(1000, start + dt.timedelta(days=4000)), (1001, start - dt.timedelta(days=4000))]
    clocks = [start + dt.timedelta(days=rnd.randrange(20), hours=rnd.randrange(24)) for _ in range(9)]
    df = spark.createDataFrame(times, "id long, t timestamp_ntz")
    table = clock_table(spark, [*clocks, clocks[0]])
    assert table.count() == len(set(clocks))

    def want(first, last):
        return Counter((c, i, t) for c in set(clocks) for i, t in times if t is not None and first(c) <= t.date()
                       and (last is None or t.date() <= last(c)))

    def day(c, n):
        return c.date() + dt.timedelta(days=n)

    assert rows(rows_in_windows(df, "t", business_windows(table))) == want(
        lambda c: day(c, 0), lambda c: day(c, 3 if c.isoweekday() == 5 else 1))
    assert rows(rows_in_windows(df, "t", open_windows(table, 4))) == want(lambda c: day(c, -3), None)
    assert rows(rows_in_windows(df, "t", past_windows(table, 10, 5))) == want(lambda c: day(c, -10), lambda c: day(c, -5))
    assert rows_in_windows(df, "t", business_windows(clock_table(spark, []))).count() == 0


def test_a_week_equals_seven_runs(flat, spark):
    assert rows(appointments_by_clock(flat, APPOINTMENT_WEEK)) == each(lambda c: appointments(flat, c), APPOINTMENT_WEEK)
    clocks = clock_table(spark, ACTIVITY_WEEK)
    assert rows(active_shipments_by_clock(flat.shipment, clocks)) == each(lambda c: active_shipments(flat.shipment, c), ACTIVITY_WEEK)
    assert rows(not_closed_by_clock(flat.shipment, flat.lpn, clocks)) == each(
        lambda c: not_closed_list(flat.shipment, flat.lpn, c), ACTIVITY_WEEK)


def test_clocks_without_rows(flat, spark):
    far = ["1990-01-01 00:00:00", ACTIVITY_WEEK[3]]
    found = {r.as_of.year: r.not_closed for r in not_closed_by_clock(flat.shipment, flat.lpn, clock_table(spark, far)).collect()}
    assert found[1990] is None and found[2001]
    assert appointments_by_clock(flat, far[:1]).count() == 0


def test_one_scan_for_all_clocks_and_no_pairs_with_clocks(flat, spark):
    plan = plan_of(rows_in_windows(flat.ilm_appointments, "scheduled_dttm", business_windows(clock_table(spark, APPOINTMENT_WEEK))))
    assert plan.count("FileScan parquet") == 1
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "HashJoin" in plan


def partitions_read(df):
    """Number of partitions that the scan of ``df`` opened, and their days."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if "FileScan parquet" in leaves.apply(i).toString()]
    assert len(scans) == 1
    files = scans[0].inputRDDs().head().filePartitions()
    days = set()
    for i in range(files.size()):
        for f in files.apply(i).files():
            path = f.filePath().toString()
            days.add(path.rsplit(f"{DAY_PARTITION}=", 1)[1].split("/")[0])
    return scans[0].metrics().get("numPartitions").get().value(), days


@pytest.fixture
def no_aqe(spark):
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", keep)


def test_one_clock_opens_the_days_of_its_window(by_day, no_aqe):
    for as_of, days in (("2024-01-10 12:00:00", {"2024-01-10", "2024-01-11"}),
                        ("2024-01-12 12:00:00", {"2024-01-12", "2024-01-13", "2024-01-14", "2024-01-15"})):
        number, names = partitions_read(window_appointments(by_day, as_of))
        assert names == days and number == len(days)
    _, names = partitions_read(watched_shipments(by_day, "2001-07-20 12:00:00"))
    assert names and min(names) >= "2001-07-10"
    everything = {str(r[0]) for r in by_day.shipment.select(DAY_PARTITION).distinct().collect()}
    assert names == {d for d in everything if d >= "2001-07-10"} != everything


def test_many_clocks_prune_at_run_time(by_day, spark, no_aqe):
    windows = business_windows(clock_table(spark, ["2024-01-10 12:00:00", "2024-01-12 12:00:00", "2024-01-20 12:00:00"]))
    df = rows_in_windows(by_day.ilm_appointments, "scheduled_dttm", windows)
    assert "dynamicpruning" in plan_of(df)
    number, names = partitions_read(df)
    assert names == {f"2024-01-{d}" for d in (10, 11, 12, 13, 14, 15, 20, 21)} and number == 8


def test_reports_over_tables_stored_by_day(flat, by_day):
    assert DAY_PARTITION in by_day.shipment.columns
    assert rows(appointments(by_day, "2024-01-12 12:00:00")) == rows(appointments(flat, "2024-01-12 12:00:00"))
    assert rows(appointments_by_clock(by_day, APPOINTMENT_WEEK)) == rows(appointments_by_clock(flat, APPOINTMENT_WEEK))
    assert rows(shipment_activity(by_day, "2001-07-20 12:00:00")) == rows(shipment_activity(flat, "2001-07-20 12:00:00"))


def test_a_row_without_a_time_is_kept_by_the_store(spark, tmp_path):
    one = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 10, 5))], "appointment_id long, scheduled_dttm timestamp_ntz")
    w = Wms(lambda name: one.withColumns({c: F.lit(None).cast("string") for c in ("tc_appointment_id", "comments")}).withColumn(
        "appt_status", F.lit(1))).stage(str(tmp_path), ["ilm_appointments"], by_day=True)
    assert w.ilm_appointments.count() == 2
    assert [r.appointment_id for r in window_appointments(w, "2024-01-09 00:00:00").collect()] == [2]
