import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quaysight.session import build_session, ensure_checkpoint_dir

    s = build_session(cores="*", shuffle_partitions=8, app_name="quaysight-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from tests.compare import duck

    return duck(SMALL)
