"""Every named query against its independent DuckDB statement (sf0.001)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from quaysight.plans.registry import QUERIES as REPORTS
from tests.compare import compare
from tests.conftest import SMALL

KEYS = list(REPORTS)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(oracle_sql()) <= set(queries())


def test_entry_imports_without_the_optional_subpackage(monkeypatch):
    import importlib.util
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("entry_alone", __spark_entry__.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(KEYS) == set(alone.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck_small, key):
    res = compare(queries()[key](spark, SMALL), duck_small, oracle_sql()[key])
    assert res["match"], res


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert len(df.columns) == 45
    assert df.count() > 0
