import pytest


@pytest.fixture(scope="module")
def rows(spark):
    """Collects a frame as a list of dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
