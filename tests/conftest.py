import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tablelens.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
