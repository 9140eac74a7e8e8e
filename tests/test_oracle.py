"""Every registered query against its DuckDB oracle (the driver's gate, run locally)."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from sigstrata.sources.adapters import TABLES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if hasattr(v, "item"):
            v = v.item()
        return "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)), key=repr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["gk", "low", "q1", "median", "q3", "high", "n"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(
    n for n in set(E.queries()) - set(E.oracle_sql()) if not re.match(r"op\d+_|pipeline", n)))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
