"""Declared keys: verified once, used by the PO split, never trusted."""

from collections import Counter

import pytest

from quaysight.plans.appointments import po_split_for
from quaysight.sources import Wms
from quaysight.sources.catalog import KeyViolation, is_key
from quaysight.sources.schemas import KEYS
from tests.conftest import SMALL
from tests.test_plans import plan_of


def with_table(w, name, df):
    """The tables of ``w`` with one of them replaced."""
    return Wms(lambda n: df if n == name else w.table(n))


def split(w):
    return po_split_for(w, w.ilm_appointment_objects, restrict=False)


def rows(df):
    return Counter(map(str, df.collect()))


def joins(df):
    return plan_of(df).count("Join ")


@pytest.fixture(scope="module")
def wms(spark, tmp_path_factory):
    return Wms.from_testdata(spark, SMALL).stage(str(tmp_path_factory.mktemp("keys")))


def test_is_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (None, "b")], "k long, v string")
    assert is_key(df, ("k",)) and not is_key(df, ("v",)) and is_key(df, ("k", "v")) and is_key(df.limit(0), ("v",))


def test_declared_keys_drop_both_joins(wms):
    declared = split(wms.declare_keys(KEYS))
    plan, least = plan_of(declared), joins(declared)   # before the run adds the final plan
    assert "/business_partner]" not in plan and "/purchase_orders_status]" not in plan
    with_joins = split(wms.declare_keys({}))
    plan = plan_of(with_joins)
    assert "/business_partner]" in plan and "/purchase_orders_status]" in plan
    assert joins(with_joins) == least + 2
    assert rows(declared) == rows(with_joins)
    one = split(wms.declare_keys({"business_partner": ("business_partner_id",)}))
    assert joins(one) == least + 1 and rows(one) == rows(declared)


def test_a_violated_key_falls_back_to_the_weights(spark, wms):
    twice = wms.business_partner.unionByName(wms.business_partner.filter("business_partner_id = 3"))
    undeclared = rows(split(with_table(wms, "business_partner", twice).declare_keys({})))
    fallback = split(with_table(wms, "business_partner", twice).declare_keys(KEYS))
    assert "/business_partner]" in plan_of(fallback) and "/purchase_orders_status]" not in plan_of(fallback)
    assert rows(fallback) == undeclared != rows(split(wms.declare_keys(KEYS)))


def test_a_violated_key_is_an_error_on_demand(wms):
    twice = with_table(wms, "purchase_orders_status", wms.purchase_orders_status.unionByName(wms.purchase_orders_status))
    with pytest.raises(KeyViolation, match="purchase_orders_status"):
        split(twice.declare_keys(KEYS, on_violation="error"))


def test_verified_once(spark, wms, monkeypatch):
    from quaysight.sources import catalog

    asked = []
    monkeypatch.setattr(catalog, "is_key", lambda df, columns: asked.append(columns) or True)
    w = with_table(wms, "", None)
    for _ in range(3):
        assert w.has_key("business_partner", ("business_partner_id",))
    assert len(asked) == 1
    assert not w.has_key("business_partner", ("description",)) and not w.has_key("slots", ("slot_id",))


def test_declarations_are_checked(wms):
    for keys in ({"nothing": ("a",)}, {"slots": ("nope",)}, {"slots": ()}):
        with pytest.raises(KeyError):
            wms.declare_keys(keys)
    with pytest.raises(ValueError, match="reaction"):
        wms.declare_keys({}, on_violation="ignore")
