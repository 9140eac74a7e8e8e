from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sigstrata.schemas import SIGNAL_SCHEMA  # noqa: E402
from sigstrata.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", app="sigstrata-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def make_sig(spark):
    def _make(rows):
        return spark.createDataFrame([(int(t), int(c), float(v)) for t, c, v in rows], SIGNAL_SCHEMA)
    return _make


def sorted_rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
