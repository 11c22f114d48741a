"""Ordered, repeatable sink; rejected rows; folders owned per report."""

import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaysight.operators import _WRITTEN, intermediates, materialize, materialize_all
from quaysight.operators.rejects import REASON, split_rejects
from quaysight.plans import appointments, dock_doors
from quaysight.plans.dock_doors import dock_order
from quaysight.sinks import ORDER_COLUMN, manifest, read_report, save_report
from quaysight.sources import Wms
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def wms(spark, tmp_path_factory):
    return Wms.from_testdata(spark, SMALL).stage(str(tmp_path_factory.mktemp("sinks")))


def test_the_order_survives_reading(spark, wms, tmp_path):
    path = str(tmp_path / "report")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entry = save_report(dock_doors(wms, ordered=False), path, dock_order())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    files = os.listdir(f"{path}/versions/{entry['version']}")
    assert sum(f.endswith(".parquet") for f in files) > 1   # dealt by range over several tasks
    got = [(r.porte_de_quai, r.arret, r.chargement) for r in read_report(spark, path).collect()]
    want = [(r.porte_de_quai, r.arret, r.chargement) for r in dock_doors(wms).collect()]
    assert got == want and len(got) == entry["rows"] > 100
    kept = read_report(spark, path, keep_order_column=True)
    assert kept.select(ORDER_COLUMN).distinct().count() == entry["rows"]


def test_null_order(spark, tmp_path):
    rows = [("b", 1), (None, 3), ("a", None), ("a", 2), ("a", 7), (None, None)] * 30
    df = spark.createDataFrame(rows, "d string, s int").repartition(5)
    save_report(df, str(tmp_path), [F.col("d").asc_nulls_last(), F.col("s").desc_nulls_first()])
    got = [tuple(r) for r in read_report(spark, str(tmp_path)).collect()]
    assert got == [x for x in (("a", None), ("a", 7), ("a", 2), ("b", 1), (None, None), (None, 3)) for _ in range(30)]


def test_a_job_that_ends_in_the_middle_leaves_the_old_report(spark, tmp_path):
    path = str(tmp_path / "r")
    assert manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    first = save_report(spark.range(10), path)
    broken = spark.range(100).repartition(4).select(
        F.when(F.col("id") == 77, F.raise_error(F.lit("ended")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="ended"):
        save_report(broken, path, [F.col("id").desc()])
    assert manifest(spark, path) == first
    assert sorted(r.id for r in read_report(spark, path).collect()) == list(range(10))
    held = read_report(spark, path)
    second = save_report(spark.range(20), path)
    assert second["before"] == first["version"] and read_report(spark, path).count() == 20
    assert held.count() == 10   # a reader of the version before still reads it
    assert set(os.listdir(f"{path}/versions")) == {first["version"], second["version"]}   # what the broken job left is gone
    third = save_report(spark.range(0), path, [F.col("id")])
    assert third["rows"] == 0 and read_report(spark, path).count() == 0
    assert set(os.listdir(f"{path}/versions")) == {second["version"], third["version"]}


def test_casts_split(spark):
    rows = [(1, "12.6", "3"), (2, "x", "3"), (3, None, ""), (4, "1", "1e3"), (5, "99999999.5", "7"), (6, "1,5", "y"), (7, " 4 ", "-2"), (7, " 4 ", "-2")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    split = split_rejects(df, {"a": "decimal(10,3)", "b": "decimal(10,3)"})
    assert (split.rows, split.rejects) == (8, 3)
    assert {r.id: r[REASON] for r in split.rejected.collect()} == {
        2: "a: not a number", 5: "a: out of range of decimal(10,3)", 6: "a: not a number"}
    assert split.good.columns == df.columns and Counter(r.id for r in split.good.collect()) == Counter([1, 3, 4, 7, 7])
    assert split.good.select(F.sum(F.nullif("b", F.lit("")).cast("decimal(10,3)"))).first()[0] == 999
    empty = split_rejects(df.limit(0), {"a": "int"})
    assert (empty.rows, empty.rejects, empty.good.count()) == (0, 0, 0)


def test_report_keeps_rejected_rows_apart(spark, wms, tmp_path):
    as_of = "2024-01-12 12:00:00"
    shown = appointments(wms, as_of)
    some = shown.select(F.substring("tc_appointment_id", 3, 6).cast("long").alias("i")).orderBy("i").first().i
    bad = spark.createDataFrame([(some, "NB_PALETTE", "three"), (10 ** 12, "NB_PALETTE", "not shown")],
                                "appointment_id long, attribute_name string, attribute_value string")
    attrs = wms.ilm_appt_custom_attribute.filter(f"NOT (appointment_id = {some} AND attribute_name = 'NB_PALETTE')").unionByName(bad)
    w = Wms(lambda name: attrs if name == "ilm_appt_custom_attribute" else wms.table(name))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        appointments(w, as_of).collect()
    out = str(tmp_path / "rejects")
    got = appointments(w, as_of, rejects_to=out)
    rejects = spark.read.parquet(out).collect()
    assert rejects and {(r.appointment_id, r.nb_pal, r[REASON]) for r in rejects} == {(some, "three", "nb_pal: not a number")}
    kept = shown.filter(F.substring("tc_appointment_id", 3, 6).cast("long") != some)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, kept.collect()))


def test_folders_belong_to_their_report(spark):
    started, ended, seen = threading.Event(), threading.Event(), {}

    def other():
        with intermediates(spark) as mine:
            df = materialize(spark.range(5), "other")
            started.set()
            ended.wait(60)
            seen["rows"] = df.count()   # still there after the first report has dropped its own
            seen["folders"] = list(mine)

    thread = threading.Thread(target=other)
    thread.start()
    started.wait(60)
    outside = list(_WRITTEN)
    with pytest.raises(RuntimeError), intermediates(spark) as mine:
        found = materialize_all({"a": spark.range(3), "b": spark.range(4)})
        assert len(mine) == 2 and _WRITTEN == outside
        folders = [f.removeprefix("file:") for f in mine]
        assert all(map(os.path.isdir, folders)) and found["b"].count() == 4
        raise RuntimeError("the report failed")
    assert not any(map(os.path.exists, folders))
    ended.set()
    thread.join()
    assert seen["rows"] == 5 and not os.path.exists(seen["folders"][0].removeprefix("file:"))


def test_batch_job_saves_versions(spark, wms, tmp_path, monkeypatch):
    import pyspark.sql

    from quaysight.jobs import main

    root = wms.lpn.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    monkeypatch.setattr(pyspark.sql.SparkSession.Builder, "getOrCreate", lambda self: spark)
    path = str(tmp_path / "out")
    for _ in range(2):
        assert main(["--tables", root, "--report", "dock_doors", "--out", path, "--versioned"]) == 0
    got, want = ([(r.porte_de_quai, r.arret, r.chargement) for r in df.collect()] for df in (read_report(spark, path), dock_doors(wms)))
    assert got == want
