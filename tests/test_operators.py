"""Operators on hand-made fixtures (FIXTURES.md §3) and properties."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigstrata.functions import box_label, day_of, detail_rows
from sigstrata.operators import (assign_pages, attach_outliers, boxplot, group_quantiles, histogram,
                                 minmax_preselect, next_cursor, outliers, overview, rollup, rollup_from_rollup, signal_page,
                                 signal_range, top_k_per_group, with_row_index)
from sigstrata.operators.slices import first_rows, rank_rows
from sigstrata.schemas import CHANNEL_SCHEMA, DAY_MS, HOUR_MS, MINUTE_MS

from .conftest import sorted_rows

ALL = (-(2 ** 62), 2 ** 62)


def exact_quantile(vals, p):
    v = sorted(vals)
    h = (len(v) - 1) * p
    lo, hi = int(h // 1), -int(-h // 1)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


def test_empty_fixture(spark, make_sig):
    empty = make_sig([])
    ch = spark.createDataFrame([], CHANNEL_SCHEMA)
    o = overview(empty, ch).first()
    assert o["total_rows"] == 0 and o["min_ts"] is None and o["max_ts"] is None and o["channels"] == []
    assert histogram(empty, 0, *ALL, 10).count() == 0
    assert outliers(empty, 0, *ALL, 500).count() == 0
    assert boxplot(empty, *ALL, bucket_ms=1000, quantile="exact").count() == 0


def test_constant_histogram_last_bin(make_sig):
    sig = make_sig([(i, 0, 3.5) for i in range(10)])
    rows = histogram(sig, 0, *ALL, 8, edges=True).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(7, 10)]


def test_histogram_dense_and_counts(make_sig):
    rnd = random.Random(1)
    sig = make_sig([(i, 0, rnd.choice([0.0, 1.0, 9.0, 10.0])) for i in range(200)])
    sparse = histogram(sig, 0, *ALL, 10).collect()
    dense = histogram(sig, 0, *ALL, 10, dense=True).collect()
    assert sum(r["n"] for r in sparse) == 200 == sum(r["n"] for r in dense)
    assert [r["bin"] for r in dense] == list(range(10))
    assert {r["bin"] for r in sparse} == {0, 1, 9}       # 9.0 and the max 10.0 share the last bin


@pytest.mark.parametrize("mode", ["exact", "approx"])
def test_boxplot_by_bucket_edges(make_sig, mode):
    w = 1000
    rows = [(k * w + d, 0, float(k * 10 + d)) for k in range(1, 4) for d in (-1, 0, 1)]
    box = {r["gk"]: r for r in boxplot(make_sig(rows), *ALL, bucket_ms=w, quantile=mode).collect()}
    assert sorted(box) == [0, 1000, 2000, 3000]
    assert box[1000]["n"] == 3 and box[1000]["low"] == 10.0 and box[1000]["high"] == 19.0


def test_exact_quantiles_with_hot_group(make_sig):
    rnd = random.Random(7)
    rows = [(i, 0, float(rnd.randint(0, 50))) for i in range(3000)]      # hot, tie-heavy group
    rows += [(i, c, rnd.random()) for c in (1, 2) for i in range(20)]
    q = group_quantiles(make_sig(rows), ["channel_id"], "value", [0.1, 0.5, 0.9], ["a", "b", "c"], mode="exact")
    got = {r["channel_id"]: r for r in q.collect()}
    for c in (0, 1, 2):
        vals = [v for _, ch, v in rows if ch == c]
        for p, nm in ((0.1, "a"), (0.5, "b"), (0.9, "c")):
            assert got[c][nm] == pytest.approx(exact_quantile(vals, p), abs=1e-12)
        assert got[c]["n"] == len(vals) and got[c]["low"] == min(vals) and got[c]["high"] == max(vals)


def test_approx_quantile_rank_error(make_sig):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(5000)]
    q = group_quantiles(make_sig([(i, 0, v) for i, v in enumerate(vals)]), [], "value", [0.25, 0.5, 0.75],
                        ["q1", "q2", "q3"], mode="approx", accuracy=100).first()
    sv = sorted(vals)
    for p, nm in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")):
        rank = sum(1 for v in sv if v <= q[nm])
        assert abs(rank - p * len(sv)) <= len(sv) / 100 + 1


def test_spiky_outliers_single_and_per_channel(make_sig):
    rows = [(i * 1000, 0, 1.0 + (i % 3) * 0.01) for i in range(300)] + [(50_500, 0, 90.0), (150_500, 0, -80.0)]
    rows += [(i * 1000, 1, 5.0) for i in range(10)]
    sig = make_sig(rows)
    single = outliers(sig, 0, *ALL, 500, quantile="exact").collect()
    assert [(r["ts"], r["value"]) for r in single] == [(50_500, 90.0), (150_500, -80.0)]
    capped = outliers(sig, 0, *ALL, 1, quantile="exact").collect()
    assert [(r["ts"], r["value"]) for r in capped] == [(50_500, 90.0)]
    multi = outliers(sig, None, *ALL, 500, quantile="exact")
    assert sorted_rows(multi, "channel_id", "ts") == [(0, 50_500), (0, 150_500)]


def test_attach_outliers_drops_points_without_box(make_sig, spark):
    pts = make_sig([(1500, 0, 9.0), (5500, 0, 9.0)]).select("ts", "value")
    boxes = spark.createDataFrame([(1000, "a")], "gk long, label string")
    got = attach_outliers(pts, boxes, 1000).collect()
    assert [(r["ts"], r["label"]) for r in got] == [(1500, "a")]


def test_signal_range_layers_and_k3(make_sig):
    rows = [(m * MINUTE_MS + s * 1000, 0, float(m)) for m in range(5) for s in (0, 30)]
    sig = make_sig(rows)
    l1 = rollup(sig, MINUTE_MS)
    start = MINUTE_MS + 10
    assert [r["ts"] for r in signal_range(l1, 0, start, 3 * MINUTE_MS, "L1").collect()] == [2 * MINUTE_MS,
                                                                                            3 * MINUTE_MS]
    aligned = signal_range(l1, 0, start, 3 * MINUTE_MS, "L1", align=True).collect()
    assert [r["ts"] for r in aligned] == [MINUTE_MS, 2 * MINUTE_MS, 3 * MINUTE_MS]
    l0 = signal_range(sig, 0, 0, 2 * MINUTE_MS, "L0", limit=3).collect()
    assert [r["ts"] for r in l0] == [0, 30_000, 60_000]


def test_rollup_counts_and_hierarchy(make_sig):
    rnd = random.Random(5)
    rows = [(rnd.randrange(0, 3 * DAY_MS), rnd.randrange(3), rnd.random()) for _ in range(2000)]
    sig = make_sig(rows)
    l1, l2 = rollup(sig, MINUTE_MS), rollup(sig, HOUR_MS)
    assert l1.agg(F.sum("n")).first()[0] == 2000 == l2.agg(F.sum("n")).first()[0]
    a = {(r["ts"], r["channel_id"]): r for r in l2.collect()}
    b = {(r["ts"], r["channel_id"]): r for r in rollup_from_rollup(l1, HOUR_MS).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["n"] == b[k]["n"] and a[k]["min_v"] == b[k]["min_v"]
        assert a[k]["avg_v"] == pytest.approx(b[k]["avg_v"], rel=1e-12)


def test_negative_ts_bucket_floor(make_sig):
    box = boxplot(make_sig([(-1, 0, 1.0), (-1000, 0, 2.0), (0, 0, 3.0)]), *ALL, bucket_ms=1000)
    assert sorted_rows(box, "gk", "n") == [(-1000, 2), (0, 1)]


def test_keyset_walk_covers_every_row_once_on_ties(make_sig):
    rnd = random.Random(11)
    rows = [(ts, ch, float(rnd.randint(0, 5))) for ts in range(0, 40, 2) for ch in range(4)]
    rows = list({r: None for r in rows})                   # distinct triples
    sig = make_sig(rows)
    seen, cursor, more = [], None, True
    while more:
        page = signal_page(sig, 7, cursor=cursor)
        got = [(r["ts"], r["channel_id"], r["value"]) for r in page.collect()]
        seen += got
        cursor, more = next_cursor(page)
        more = more and len(got) == 7
    assert sorted(seen) == sorted(rows) and len(seen) == len(rows)


def test_keyset_compat_skips_rest_of_tie(make_sig):
    sig = make_sig([(10, c, 1.0) for c in range(4)] + [(5, 0, 1.0)])
    first = signal_page(sig, 2).collect()
    nxt = signal_page(sig, 2, cursor=first[-1]["ts"], compat=True).collect()
    assert [r["ts"] for r in nxt] == [5]


def test_assign_pages_matches_order(make_sig):
    rows = [(ts, ch, 1.0) for ts in range(50) for ch in range(3)]
    got = assign_pages(make_sig(rows), 10).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    want = {r: (i // 10, i % 10) for i, r in enumerate(order)}
    assert {(r["ts"], r["channel_id"], r["value"]): (r["page"], r["pos"]) for r in got} == want


def test_row_index_hot_key_spreads_and_is_dense(make_sig, spark):
    rows = [(0, 0, 1.0)] * 5000 + [(i, 1, float(i)) for i in range(100)]   # one key holds most rows
    idx = with_row_index(make_sig(rows), [F.col("ts").asc()], ["channel_id"], size_col="n")
    got = {}
    for r in idx.collect():
        got.setdefault(r["channel_id"], []).append(r["idx"])
    assert sorted(got[0]) == list(range(5000)) and sorted(got[1]) == list(range(100))


def test_top_k_both_paths(make_sig, spark):
    rows = [(i, i % 3, float(i)) for i in range(3000)]
    sig = make_sig(rows)
    small = top_k_per_group(sig, ["channel_id"], ["ts", "value"], 5)
    assert sorted_rows(small, "channel_id", "ts")[:5] == [(0, 0), (0, 3), (0, 6), (0, 9), (0, 12)]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        big = top_k_per_group(sig, ["channel_id"], ["ts", "value"], 5)
        assert sorted_rows(big, "channel_id", "ts") == sorted_rows(small, "channel_id", "ts")
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_day_edges_and_labels(make_sig, spark):
    sig = make_sig([(DAY_MS - 1, 0, 1.23456), (DAY_MS, 0, 2.0)])
    d = sig.select(day_of("ts").alias("d")).collect()
    assert [str(r["d"]) for r in d] == ["1970-01-01", "1970-01-02"]
    rows = detail_rows(sig).collect()
    assert rows[0]["time_text"] == "1970-01-01 23:59:59.999" and rows[0]["value_text"] == "1.235"
    assert rows[0]["channel_label"] == "CH-0" and rows[0]["row_key"] == f"{DAY_MS - 1}-0"
    tz = detail_rows(sig, tz="Asia/Shanghai").collect()
    assert tz[1]["time_text"] == "1970-01-02 08:00:00.000"
    lab = spark.createDataFrame([(DAY_MS + 3_660_000,)], "gk long").select(box_label("gk").alias("l")).first()
    assert lab["l"] == "01-02 01:01"


def test_session_zone_does_not_change_ms(spark):
    from sigstrata.sources.adapters import event_signals
    base = sorted_rows(event_signals(spark, "/root/testdata/sf0.001")[0].select("ts"))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = sorted_rows(event_signals(spark, "/root/testdata/sf0.001")[0].select("ts"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other


def test_median_exact_vs_python(make_sig):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    box = boxplot(make_sig([(i, 0, v) for i, v in enumerate(vals)]), *ALL, quantile="exact").first()
    assert box["median"] == statistics.median(vals)


def test_large_row_guard(make_sig, monkeypatch):
    import sigstrata.operators.reads as R
    monkeypatch.setattr(R, "TOP_K_MAX", 10)
    rows = [(i // 2, i % 2, float(i)) for i in range(4000)]
    sig = make_sig(rows)
    got = signal_range(sig, None, *ALL, "L0", limit=1500).collect()
    want = [r for c in (0, 1) for r in sorted(r for r in rows if r[1] == c)[:1500]]      # the guard is per channel
    assert [(r["channel_id"], r["ts"]) for r in got] == [(c, t) for t, c, _ in want]
    one = signal_range(sig, 1, *ALL, "L0", limit=150).collect()
    assert [r["ts"] for r in one] == sorted(t for t, c, _ in rows if c == 1)[:150]
    layer = signal_range(rollup(sig, 10), 1, *ALL, "L1", limit=50, envelope=True).collect()
    assert [r["ts"] for r in layer] == list(range(0, 500, 10))


@pytest.mark.parametrize("slice_rows", [7, 100_000])
@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "gap", "empty"])
def test_ranks_by_slice_counts(make_sig, kind, slice_rows):
    rnd = random.Random(4)
    rows = {"spread": [(rnd.randint(-10**12, 10**12), rnd.randint(0, 2), rnd.random()) for _ in range(900)],
            "ties": [(rnd.choice([0, 5]), rnd.randint(0, 2), rnd.choice([-1.0, 2.0, rnd.gauss(0, 9)])) for _ in range(900)],
            "equal": [(7, 1, 2.5)] * 700 + [(7, 1, 2.0), (6, 0, 1.0)], "empty": [],
            "gap": [(i, 0, 1.0) for i in range(400)] + [(10**15, 0, 1.0), (10**15 + 1, 2, float("inf"))]}[kind]
    sig = make_sig(rows)
    down = rank_rows(sig, [("ts", True), ("channel_id", False), ("value", False)], slice_rows=slice_rows).collect()
    assert sorted(r.idx for r in down) == list(range(len(rows)))
    assert [tuple(r)[:3] for r in sorted(down, key=lambda r: r.idx)] == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    each = rank_rows(sig, [("ts", False), ("value", False)], ["channel_id"], size_col="n", slice_rows=slice_rows).collect()
    for c in {r[1] for r in rows}:
        own = sorted((t, v) for t, ch, v in rows if ch == c)
        got = sorted((r for r in each if r.channel_id == c), key=lambda r: r.idx)
        assert [(r.ts, r.value, r.idx, r.n) for r in got] == [(t, v, i, len(own)) for i, (t, v) in enumerate(own)]
    first = first_rows(sig, [("ts", False), ("value", False)], 50, ["channel_id"], slice_rows=slice_rows).collect()
    assert sorted(tuple(r) for r in first) == sorted((t, c, v) for c in range(3) for t, v in sorted((t, v) for t, ch, v in rows if ch == c)[:50])


def test_ranks_need_neither_a_global_sort_nor_a_copy(spark, tmp_path, make_sig):
    path = str(tmp_path / "sig")
    make_sig([(i, i % 3, float(i % 7)) for i in range(500)]).write.parquet(path)
    sig = spark.read.parquet(path)
    for df in (assign_pages(sig, 10), minmax_preselect(sig, 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "FileScan" in plan


def test_dictionary_ranking_is_dense(spark):
    from sigstrata.sources.adapters import channel_dictionary
    names = spark.createDataFrame([(f"n{i:05d}",) for i in range(3000)] * 2, "name string")
    got = channel_dictionary(names).collect()
    assert sorted((r["id"], r["name"]) for r in got) == [(i, f"n{i:05d}") for i in range(3000)]


def test_row_index_splits_hot_group_of_identical_copies(make_sig, spark):
    sig = make_sig([(7, 0, 1.0)] * 6000 + [(i, 0, 2.0) for i in range(50)]).repartition(6)
    idx = with_row_index(sig, [F.col("ts").asc(), F.col("value").asc()], ["channel_id"], size_col="n")
    rows = idx.collect()
    assert sorted(r["idx"] for r in rows) == list(range(6050)) and {r["n"] for r in rows} == {6050}
    order = sorted(rows, key=lambda r: r["idx"])
    assert [(r["ts"], r["value"]) for r in order] == sorted((r["ts"], r["value"]) for r in rows)


def _built_in(df, keys, value, probs, names):
    agg = df.groupBy(*keys).agg(F.min(value).alias("low"), F.percentile(value, probs).alias("q"), F.max(value).alias("high"),
                                F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "low", *[F.col("q")[i].alias(x) for i, x in enumerate(names)], "high", "n")


@pytest.mark.parametrize("accuracy, probs", [(1, [0.25, 0.5, 0.75]), (40, [0.9, 0.1, 0.5, 0.5, 0.501]), (10_000, [0.0, 1.0, 0.3])])
def test_exact_quantiles_equal_the_built_in_function(make_sig, accuracy, probs):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), rnd.choice([float(rnd.randint(0, 30)), rnd.gauss(0, 1e6)])) for i in range(3000)] + [(1, 7, 2.5)]
    sig, names = make_sig(rows), [f"p{i}" for i in range(len(probs))]
    for keys in (["channel_id"], []):
        got = group_quantiles(sig, keys, "value", probs, names, mode="exact", accuracy=accuracy)
        assert sorted_rows(got) == sorted_rows(_built_in(sig, keys, "value", probs, names))


def test_large_brackets_are_narrowed_by_counts(make_sig, monkeypatch):
    import sigstrata.operators.quantiles as Q
    monkeypatch.setattr(Q, "BRACKET_VALUES", 20)
    monkeypatch.setattr(Q, "CELLS", 4)
    rnd = random.Random(2)
    sig = make_sig([(i, i % 2, rnd.choice([1e300, -1e300, 5.0, rnd.random(), rnd.random() * 1e-9])) for i in range(1500)])
    got = group_quantiles(sig, ["channel_id"], "value", [0.1, 0.5, 0.8], ["a", "b", "c"], mode="exact", accuracy=2000)
    assert sorted_rows(got) == sorted_rows(_built_in(sig, ["channel_id"], "value", [0.1, 0.5, 0.8], ["a", "b", "c"]))


def test_exact_quantiles_scan_twice_and_keep_no_copy(spark, tmp_path, make_sig):
    path = str(tmp_path / "sig")
    make_sig([(i, i % 3, float(i)) for i in range(500)]).write.parquet(path)
    df = group_quantiles(spark.read.parquet(path), ["channel_id"], "value", [0.5], ["m"], mode="exact", accuracy=20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "ExistingRDD" in plan     # only small tables are left to read


@pytest.mark.parametrize("case", ["downsample", "preselect", "assign_pages", "outliers_multi", "outliers_ranked",
                                  "hist_dense_multi", "hist_dense_single", "box_ranked", "range_guard_big"])
def test_empty_inputs_everywhere(make_sig, case):
    from sigstrata.operators import downsample, minmax_preselect
    e = make_sig([])
    build = {
        "downsample": lambda: downsample(e, 10),
        "preselect": lambda: minmax_preselect(e, 10),
        "assign_pages": lambda: assign_pages(e, 10),
        "outliers_multi": lambda: outliers(e, None, 0, 10, 5, quantile="exact"),
        "outliers_ranked": lambda: outliers(e, None, 0, 10, 5, quantile="exact", accuracy=2),
        "hist_dense_multi": lambda: histogram(e, None, 0, 10, 4, dense=True, edges=True),
        "hist_dense_single": lambda: histogram(e, 0, 0, 10, 4, dense=True),
        "box_ranked": lambda: boxplot(e, 0, 10, quantile="exact", accuracy=2),
        "range_guard_big": lambda: signal_range(e, 0, 0, 10, "L0", limit=10 ** 6),
    }[case]
    assert build().count() == 0


def test_next_cursor_stops_at_a_short_page(make_sig):
    page = signal_page(make_sig([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)]), 3)
    assert next_cursor(page, 3) == ((1, 0, 1.0), True) and next_cursor(page, 500) == ((1, 0, 1.0), False)


def test_ties_at_a_cut_go_by_value(make_sig):
    sig = make_sig([(0, 0, float(v % 10)) for v in range(40)] + [(1, 0, 1000.0), (1, 0, 900.0), (1, 0, 950.0), (5, 1, 3.0)])
    assert [r["value"] for r in outliers(sig, 0, 0, 10, 2, quantile="exact").collect()] == [900.0, 950.0]
    assert outliers(sig, 0, 0, 10, None, quantile="exact").count() == 3
    guard = signal_range(sig, None, 0, 10, limit=2)
    assert [tuple(r) for r in guard.collect()] == [(0, 0, 0.0), (0, 0, 0.0), (1, 5, 3.0)]


@pytest.mark.parametrize("rows", [
    [(None, 0), (1.0, 0), (2.0, 0), (3.0, 0)], [(None, None), (4.0, None), (1.0, 1)], [(None, 3), (None, 3)],
    [(float("nan"), 0), (1.0, 0)], [(2.0, 0)] * 5,
])
def test_exact_quantiles_of_nulls_and_nans(spark, rows):
    df = spark.createDataFrame(rows, "v double, k int")
    for keys in (["k"], []):
        want = sorted(map(str, _built_in(df, keys, "v", [0.25, 0.5], ["q1", "med"]).collect()))
        for accuracy in (1, 10_000):
            got = group_quantiles(df, keys, "v", [0.25, 0.5], ["q1", "med"], mode="exact", accuracy=accuracy)
            assert sorted(map(str, got.collect())) == want


def test_frames_have_one_schema_even_when_empty(spark, make_sig):
    from sigstrata.sources.delivery import iter_frames
    sig = make_sig([(i, 0, float(i)) for i in range(10)])
    full, empty = list(iter_frames(sig, 4)), list(iter_frames(sig.limit(0)))
    assert len(empty) == 1 and empty[0].num_rows == 0 and {f.schema for f in full} == {empty[0].schema}


def test_message_without_rows_is_no_error(spark):
    from sigstrata.sources.ingest import parse_rows
    good, bad = parse_rows(spark.createDataFrame([('{"rows":[]}',), ("x",)], "message string"))
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["unparsable message"]
