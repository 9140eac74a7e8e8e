"""Plan shapes and viewport rules (V1-V9)."""

from __future__ import annotations

import pytest

from sigstrata.operators import boxplot, outliers, signal_page, with_row_index
from sigstrata.plans.panels import boxplot_panel, signal_series
from sigstrata.plans.viewport import drill, pick_bucket_ms, pick_layer, slide_to, zoom
from sigstrata.schemas import DAY_MS, HOUR_MS, MINUTE_MS
from sigstrata.operators import rollup

MIN = 60_000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("span,layer,bucket", [
    (5 * MIN, "L0", 10_000), (HOUR_MS, "L0", 300_000), (DAY_MS, "L0", 3_600_000), (2 * DAY_MS, "L0", 21_600_000),
    (7 * DAY_MS, "L1", 21_600_000), (14 * DAY_MS, "L1", DAY_MS), (30 * DAY_MS, "L2", DAY_MS),
    (41 * DAY_MS, "L2", 7 * DAY_MS)])
def test_layer_and_bucket_truth_table(span, layer, bucket):
    assert pick_layer(span) == layer and pick_bucket_ms(span) == bucket


def test_viewport_helpers():
    assert slide_to(10_000, 3_000) == (7_000, 10_000)
    assert zoom(0, 10_000, 25, 50) == (2_500, 5_000)
    assert zoom(0, 1_000, 0, 50) is None
    assert drill(60_000, 60_000) == (60_000, 120_000)
    with pytest.raises(ValueError):
        pick_layer(float("nan"))


def test_keyset_page_is_top_k_not_sort(make_sig):
    sig = make_sig([(i, i % 3, float(i)) for i in range(100)])
    assert "TakeOrderedAndProject" in _plan(signal_page(sig, 10))


def test_outlier_fence_is_scalar_subquery(make_sig):
    sig = make_sig([(i, 0, float(i)) for i in range(100)])
    plan = _plan(outliers(sig, 0, 0, 1000, 5))
    assert "Subquery" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_row_index_never_collects_rows_into_one_partition(make_sig):
    sig = make_sig([(i, i % 2, float(i)) for i in range(500)])
    plan = _plan(with_row_index(sig, ["ts"], ["channel_id"]))
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_top_k_uses_partial_window_group_limit(make_sig):
    sig = make_sig([(i, i % 2, float(i % 7)) for i in range(500)])
    plan = outliers(sig, None, 0, 10_000, 5)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_approx_box_is_partial_aggregate(make_sig):
    sig = make_sig([(i, 0, float(i)) for i in range(100)])
    plan = _plan(boxplot(sig, 0, 10_000, bucket_ms=10))
    assert "partial_percentile_approx" in plan


def test_signal_series_picks_layer_and_budget(make_sig):
    rows = [(i * MINUTE_MS, c, float(i % 50)) for c in range(2) for i in range(4 * 24 * 60)]
    sig = make_sig(rows)
    layers = {"L0": sig, "L1": rollup(sig, MINUTE_MS), "L2": rollup(sig, HOUR_MS)}
    out = signal_series(layers, None, 0, 4 * DAY_MS, pixel_width=100)        # > 2 d -> L1, 5760 pts
    counts = {r["channel_id"]: r["count"] for r in out.groupBy("channel_id").count().collect()}
    assert counts == {0: 200, 1: 200}
    one = signal_series(layers, 1, 0, 4 * DAY_MS, pixel_width=100)
    assert {r["channel_id"] for r in one.collect()} == {1}


def test_boxplot_panel(make_sig):
    rows = [(i * 1000, 0, 1.0 + (i % 4)) for i in range(3600)] + [(1_800_500, 0, 500.0)]
    panel = boxplot_panel(make_sig(rows), 0, 0, 3_600_000, quantile="exact")
    assert panel.bucket_ms == 300_000 and panel.boxes.count() == 12
    pts = panel.points.collect()
    assert [(p["gk"], p["value"], p["label"]) for p in pts] == [(1_800_000, 500.0, "01-01 00:30")]


def test_cancel_running_query(spark):
    import threading
    import time as _time
    from sigstrata.session import cancel, query_tag
    errors = []

    def run():
        try:
            with query_tag(spark, "slow-chart"):
                spark.range(0, 10 ** 11, numPartitions=2000).selectExpr("sum(id * id % 7)").collect()
        except Exception as exc:  # noqa: BLE001
            errors.append(exc)

    th = threading.Thread(target=run)
    th.start()
    t0 = _time.time()
    while th.is_alive() and _time.time() - t0 < 60:
        cancel(spark, "slow-chart")
        th.join(0.5)
    assert not th.is_alive() and errors and _time.time() - t0 < 30


def test_zoom_columns_refuse_less_than_a_second(spark, make_sig):
    from sigstrata.plans.viewport import between_columns, quick_range, zoom_columns
    sig = make_sig([(i * 100, 0, 1.0) for i in range(21)])
    s, e = quick_range(sig, None)
    assert between_columns(sig, *zoom_columns(s, e, 0.0, 50.0)).count() == 11
    assert between_columns(sig, *zoom_columns(s, e, 0.0, 40.0)).count() == 0


def test_panel_keeps_all_outliers_unless_cut(make_sig):
    rows = [(i * 1000, 0, float(i % 10)) for i in range(4000)] + [(i * 1000 + 1, 0, 1e6 + i) for i in range(600)]
    whole, cut = (boxplot_panel(make_sig(rows), 0, 0, 4_000_000, quantile="exact", max_points=m) for m in (None, 500))
    assert whole.points.count() == 600 and cut.points.count() == 500
    assert whole.outliers.first()[0] == cut.outliers.first()[0] == 600


def test_adaptive_series_reaches_the_lttb_stage(spark):
    import __spark_entry__ as e
    for name in ("signal_series_l0", "signal_series_l1", "signal_series_l2"):
        df = e.queries()[name](spark, "/root/testdata/sf0.01")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "Python" not in plan and "Arrow" not in plan and "ObjectHashAggregate" in plan
        assert {r["count"] for r in df.groupBy("channel_id").count().collect()} == {200}
