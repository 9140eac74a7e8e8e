"""Downsampling kernels (E1-E3): results worked out by hand, and properties from the definitions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from sigstrata.operators import downsample, lttb_picks, minmax_preselect, point_budget


def expected_preselect(ys, buckets):
    """Positions that MinMax preselect emits, in order: the extremes of each index bucket."""
    if len(ys) <= 2 * buckets:
        return list(range(len(ys)))
    at = pd.DataFrame({"y": ys, "b": (np.arange(1, len(ys) + 1) * buckets - 1) // len(ys)})
    ends = at.groupby("b")["y"].agg(["idxmin", "idxmax"])       # the first on ties
    return np.sort(ends.to_numpy(), axis=1).ravel().tolist()


def buckets_of(n, t):
    """Index ranges of the inner buckets: their width is a floating-point number."""
    cut = [math.floor(b * ((n - 2) / (t - 2))) + 1 for b in range(t - 1)]
    return list(zip(cut, cut[1:]))


def kept(spark, series, t, origin=0):
    """Positions that LTTB keeps of each of ``series`` (lists of values, one second apart)."""
    rows = [(k, [(origin + i, float(v)) for i, v in enumerate(ys)]) for k, ys in enumerate(series)]
    df = spark.createDataFrame(rows, "k int, points array<struct<ts: bigint, value: double>>")
    got = df.select("k", lttb_picks("points", t)["ts"].alias("at")).collect()
    return [[x - origin for x in r["at"]] for r in sorted(got, key=lambda r: r["k"])]


@pytest.mark.parametrize("ys,t,want", [
    ([0, 1, 9, 2, 0], 3, [0, 2, 4]),                 # one bucket: the highest point over the base line
    ([0, 3, 1, -4, 2, 0], 4, [0, 1, 3, 5]),          # twice the areas: 11.5 to 5.5, then 22 to 5
    ([0, 0, 0, 0, 0, 0], 4, [0, 1, 3, 5]),           # all areas equal: the earliest of each bucket
    ([5, 1, 2], 3, [0, 1, 2]), ([5, 1, 2, 7], 2, [0, 1, 2, 3]),
])
def test_lttb_worked_out_by_hand(spark, ys, t, want):
    assert kept(spark, [ys], t, origin=10**12) == [want]


@pytest.mark.parametrize("t", [1, 3, 4, 11, 80])
def test_lttb_picks_the_largest_triangle_of_each_bucket(spark, t):
    rnd = random.Random(t)
    series = [[rnd.choice([rnd.randint(-1000, 1000), rnd.randint(-2, 2)]) for _ in range(n)] for n in [1, 2, 3, 4, 5, t, t + 1, 8 * t, *rnd.sample(range(6, 300), 20)]]
    for ys, keep in zip(series, kept(spark, series, t)):
        check_triangles(ys, t, keep)


def check_triangles(ys, t, keep):
    x, y = range(len(ys)), ys
    if t >= len(ys) or t < 3:
        assert keep == list(range(len(ys)))
        return
    ranges = buckets_of(len(ys), t)
    assert len(keep) == t and keep[0] == 0 and keep[-1] == len(ys) - 1
    assert all(a <= k < b for k, (a, b) in zip(keep[1:], ranges))
    for before, pick, (a, b), after in zip(keep, keep[1:], ranges, [*ranges[1:], (len(ys) - 1, len(ys))]):
        centre = [Fraction(int(sum(v[after[0]:after[1]])), after[1] - after[0]) for v in (x, y)]

        def area(j):
            matrix = [[int(x[before]), int(y[before]), 1], [j, ys[j], 1], [*centre, 1]]
            return abs(sum(matrix[0][i] * (matrix[1][(i + 1) % 3] * matrix[2][(i + 2) % 3]
                                           - matrix[1][(i + 2) % 3] * matrix[2][(i + 1) % 3]) for i in range(3)))

        assert area(pick) >= max(map(area, range(a, b))) * (1 - Fraction(1, 10**12))


def test_lttb_keeps_spikes(spark):
    y = [0.0] * 1000
    y[300], y[700] = 50.0, -40.0
    assert {300, 700} <= set(kept(spark, [y], 40)[0])


def test_point_budget():
    assert point_budget(50) == 200 and point_budget(800) == 1600


def _series(make_sig, ys, channel=0, step=1000):
    return make_sig([(i * step, channel, v) for i, v in enumerate(ys)])


@pytest.mark.parametrize("n,buckets", [(10, 3), (7, 3), (1000, 50), (1001, 50), (64, 32)])
def test_preselect_matches_the_extremes_of_each_bucket(make_sig, n, buckets):
    rnd = random.Random(n)
    ys = [float(rnd.randint(0, 20)) for _ in range(n)]    # many ties: first index must win
    got = minmax_preselect(_series(make_sig, ys), buckets).orderBy("seq").collect()
    want = expected_preselect(ys, buckets)
    assert [r["ts"] // 1000 for r in got] == want


@pytest.mark.parametrize("slice_rows", [1, 3, 50])
def test_preselect_of_crowded_times_and_gaps(make_sig, slice_rows):
    rnd = random.Random(slice_rows)
    points = sorted((rnd.choice([0, 0, 1, 2, 500, 10**9]), float(rnd.randint(0, 9))) for _ in range(700))
    got = minmax_preselect(make_sig([(t, 3, v) for t, v in points]), 25, slice_rows=slice_rows).orderBy("seq").collect()
    want = expected_preselect([v for _, v in points], 25)
    assert [(r["ts"], r["value"]) for r in got] == [points[i] for i in want]


def test_preselect_constant_emits_duplicates(make_sig):
    got = minmax_preselect(_series(make_sig, [5.0] * 40), 4).orderBy("seq").collect()
    assert [r["ts"] // 1000 for r in got] == [0, 0, 10, 10, 20, 20, 30, 30]


@pytest.mark.parametrize("n,t", [(30, 50), (300, 50), (401, 50), (2000, 50)])
def test_downsample_dispatch(spark, make_sig, n, t):
    rnd = random.Random(n)
    ys = [rnd.gauss(0, 1) for _ in range(n)]
    got = downsample(_series(make_sig, ys), t).orderBy("seq").collect()
    pre = np.array(expected_preselect(ys, 4 * t) if n > 8 * t else range(n))
    rows = [(0, [(int(i) * 1000, ys[i]) for i in pre])]
    points = spark.createDataFrame(rows, "k int, points array<struct<ts: bigint, value: double>>")
    want = [ts // 1000 for ts in points.select(lttb_picks("points", t)["ts"]).first()[0]]
    assert [r["ts"] // 1000 for r in got] == want
    assert [r["seq"] for r in got] == list(range(len(want)))


def test_downsample_many_series_in_parallel(make_sig, spark):
    rows = [(i * 10, ch, float((i * (ch + 3)) % 17)) for ch in range(4) for i in range(900)]
    out = downsample(make_sig(rows), 100)
    counts = {r["channel_id"]: r["count"] for r in out.groupBy("channel_id").count().collect()}
    assert counts == {0: 100, 1: 100, 2: 100, 3: 100}
