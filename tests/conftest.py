import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patchlore.session import build_session  # noqa: E402

LARGE = {"patchlore.hot.rows": "3", "patchlore.block.rows": "3"}


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app="tests")
    yield s
    s.stop()


@pytest.fixture(params=["small", "large"])
def plans(request, spark):
    """Run a test as it is and again with tiny blocks and hot keys, so that groups are split."""
    if request.param == "large":
        for k, v in LARGE.items():
            spark.conf.set(k, v)
    yield request.param
    for k in LARGE:
        spark.conf.unset(k)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
