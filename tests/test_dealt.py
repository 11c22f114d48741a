"""Rows without a key are dealt over the tasks of an outer join; task sizes."""

import re

import pytest
from pyspark.sql import functions as F

from quaysight.operators import left_join_dealt
from quaysight.plans.dock_doors import PIECE_COLUMNS, tagged_pieces
from quaysight.session import BATCH_CONF, TASK_CONF, tune_session


@pytest.fixture
def shuffled(spark):
    """Joins are shuffled, and keep their partitions."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_without_a_key_are_dealt(shuffled):
    big = shuffled.range(400).select((F.when(F.col("id") % 4 == 0, F.col("id") % 7)).alias("k"), F.col("id").alias("at"))
    small = shuffled.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "key long, v string")
    found = left_join_dealt(big, small, "k", "key", ["at"])
    plain = big.join(small, big.k == small.key, "left")
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.where("k IS NULL").select(F.spark_partition_id()).distinct().count() > 1


def test_pieces_without_a_shipment_meet_in_no_one_task(shuffled):
    def piece(shipment, code, weight):
        values = {"shipment_id": shipment, "tc_shipment_id": code, "estimated_weight": weight}
        return tuple(values.get(c) for c in PIECE_COLUMNS)

    schema = ("shipment_id long, tc_shipment_id string, d_facility_alias_id string, lpn_facility_status int, "
              "container_type string, curr_sub_locn_id string, estimated_weight double")
    pieces = [piece(None, None, 1.0), piece(1, None, 2.0), piece(None, "B", 3.0), piece(1, "B", 4.0), piece(9, "Z", 5.0),
              piece(None, "B", 3.0)]
    keys = shuffled.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (None, None)], "shipment_id long, tc_shipment_id string")
    found = tagged_pieces(shuffled.createDataFrame(pieces, schema), keys)
    rows = sorted((r.estimated_weight, r._by_id, r._by_code) for r in found.collect())
    assert rows == [(2.0, True, None), (3.0, None, True), (3.0, None, True), (4.0, True, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    for column in ("shipment_id", "tc_shipment_id"):
        assert re.search(rf"hashpartitioning\({column}#\d+L?, _deal#", plan), plan


def test_task_sizes_are_set_unless_the_session_names_them(spark):
    other = spark.newSession()
    other.conf.set(BATCH_CONF[0], "1m")
    tune_session(other)
    assert other.conf.get(BATCH_CONF[0]) == "1m"
    fresh = spark.newSession()
    tune_session(fresh)
    assert dict([BATCH_CONF, TASK_CONF]) == {k: fresh.conf.get(k) for k, _ in (BATCH_CONF, TASK_CONF)}
