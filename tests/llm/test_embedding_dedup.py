from __future__ import annotations

import math

import numpy as np
import pytest

from sigstrata.llm import embedding_dedup as ed
from sigstrata.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.conftest import groups


def plain(rows, threshold=0.95):
    """rows: (id, vector) with distinct ids; every pair in double precision."""
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows
            if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold]
    root, n = groups(links, [i for i, _ in rows]), {i: 0 for i, _ in rows}
    for pair in links:
        for i in pair:
            n[i] += 1
    return {i: (n[i], root[i], root[i] == i) for i, _ in rows}


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("strip", [64, 4096])
def test_whole_table_equals_brute_force(spark, strip):
    df = table(spark, SF_SMALL.replace("0.001", "0.01"), "embeddings")
    want = plain([(r.vec_id, list(r.embedding)) for r in df.collect()])
    assert result(ed.near_duplicates(df, strip=strip)) == want


@pytest.mark.parametrize("strip", [16, 500])
def test_dense_groups_copies_and_borderline_pairs(spark, strip):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 12))
    rows = [(1000 - i, [float(x) for x in base[i % 4] + rng.normal(size=12) * 0.15]) for i in range(300)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000 + i, [2 * x for x in rows[1][1]]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(ed.near_duplicates(df, strip=strip)) == plain(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]),
            (8, [1e200, 1e200]), (9, [1e-200, 1e-200]), (10, [1.0, 1.0, 1.0]), (11, [-1.0, -1.0]), (12, [3.0])]
    schema = "vec_id long, embedding array<double>, label int, copies int, rep string"
    df = spark.createDataFrame([(*r, 1, None, "x") for r in rows], schema)
    got = result(ed.near_duplicates(df))
    assert got == plain(rows) and got[9] == (2, 7, False)
    assert ed.near_duplicates(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [5.0, -1.0])],
                                  "vec_id long, embedding array<float>")
    assert sorted(map(str, map(tuple, ed.near_duplicates(twice).collect()))) == sorted(map(str, [
        (7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, None), (None, 0, None, None)]))
