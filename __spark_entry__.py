"""

Signals come from the driver tables through the adapters in ``sigstrata.sources.adapters``:
``events`` (ts = event time in ms, channel = event type) and, for volume and ties,
``lineitem`` (ts = ship date in ms, channel = return flag, value = extended price). Every
query reads whole tables; viewport bounds cover the whole data unless the bound itself is
the feature (quick ranges, drill-down, zoom), in which case it is derived from the data.

Computed doubles are rounded to 6 decimals on both sides so that summation order cannot
change the value hash.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

# The driver may load this file by path from another working directory.
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigstrata.functions.labels import box_label, detail_rows
from sigstrata.operators import (assign_pages, attach_outliers, boxplot, downsample, histogram, minmax_preselect,
                                 next_cursor, outliers, overview, rollup, rollup_from_rollup, signal_page,
                                 signal_range, with_channel_names)
from sigstrata.plans.panels import boxplot_panel, signal_series
from sigstrata.plans.viewport import between_columns, drill_boxes, quick_range, zoom_columns
from sigstrata.schemas import DAY_MS, HOUR_MS, MINUTE_MS, SIGNAL_STORED_SCHEMA
from sigstrata.session import delete_path, materialize, scratch_path
from sigstrata.sources.adapters import ensure_channels, event_signals, lineitem_signals, read_table, to_signals
from sigstrata.sources.ingest import encode_rows, parse_rows
from sigstrata.sources.store import SignalStore
from sigstrata.streaming.jobs import await_end, file_source, ingest_totals, start_ingest, start_rollup

SMOKE_DIR = "/root/testdata/sf0.001"

# Whole-data viewport: every ts of the driver tables lies inside it.
ALL_START, ALL_END = 0, 4_102_444_800_000
# Fixed values of the registered cases.
T0 = 1_704_067_200_000          # 2024-01-01 00:00:00 UTC, first day of `events`
PAGE = 500                      # client page size
OUTLIER_CAP = 500               # client outlier cap
HIST_BINS = 20
DENSE_BINS = 200
PRESELECT_BUCKETS = 100
RANKED_ACCURACY = 50
SKETCH_ERROR = 0.02
L1_VIEW = (T0 + 3 * DAY_MS + 1_800_000, T0 + 10 * DAY_MS)   # unaligned start exercises K3
L2_VIEW = (T0 + 2 * DAY_MS + 1_234_567, T0 + 25 * DAY_MS)
ARCHIVE_1 = T0 + 10 * DAY_MS + 5 * HOUR_MS     # not midnight: aligned down by the store
ARCHIVE_2 = T0 + 20 * DAY_MS
INCREMENT_AT = T0 + 15 * DAY_MS + 7 * HOUR_MS
SERIES_L0 = (T0 + 5 * DAY_MS, T0 + 7 * DAY_MS)      # two days read L0, thirteen L1
SERIES_L1 = (T0 + 5 * DAY_MS, T0 + 18 * DAY_MS)
PANEL_DAY = (T0 + 5 * DAY_MS, T0 + 6 * DAY_MS)      # boxes of one hour
STREAM_BATCHES = 8
FOLLOW_SPAN = 6 * HOUR_MS
GUARD = 300                     # row guard on a curve read, rows per channel (K22)
ONE_CHANNEL = 0
SMALL_CAP = 5                   # an outlier cap that binds
WEEK_MS = 7 * DAY_MS            # box width the panel picks for the whole-data span


def _r(c, d: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return event_signals(spark, d)[0]


def _li(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_signals(spark, d)[0]


def _round_box(df: DataFrame) -> DataFrame:
    return df.select("gk", "low", _r("q1").alias("q1"), _r("median").alias("median"), _r("q3").alias("q3"),
                     "high", "n")


def _stable_avg(df: DataFrame) -> DataFrame:
    """Replace ``avg_v`` by ``round(round(avg_v * n, 6) / n, 6)``.

    ``avg_v * n`` recovers the bucket sum far inside 1e-6 whatever the summation order, so
    both engines then divide identical doubles; a plain rounded mean can straddle a rounding
    boundary when the exact mean ends in 5 at the 7th decimal.
    """
    return df.withColumn("avg_v", _r(_r(F.col("avg_v") * F.col("n")) / F.col("n")))


def _round_rollup(df: DataFrame) -> DataFrame:
    return _stable_avg(df).select("ts", "channel_id", "avg_v", "min_v", "max_v", "n")


# ---------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------

def q_boxplot_by_time(spark, d):
    return _round_box(boxplot(_ev(spark, d), ALL_START, ALL_END, bucket_ms=DAY_MS, quantile="exact"))


def q_boxplot_by_channel(spark, d):
    return _round_box(boxplot(_ev(spark, d), ALL_START, ALL_END, quantile="exact"))


def q_boxplot_lineitem_week(spark, d):
    return _round_box(boxplot(_li(spark, d), ALL_START, ALL_END, bucket_ms=7 * DAY_MS, quantile="exact"))


def q_boxplot_by_time_ranked(spark, d):
    # a coarse sketch: brackets hold a share of the rows only
    return _round_box(boxplot(_ev(spark, d), ALL_START, ALL_END, bucket_ms=DAY_MS, quantile="exact",
                              accuracy=RANKED_ACCURACY))


def q_boxplot_lineitem_ranked(spark, d):
    return _round_box(boxplot(_li(spark, d), ALL_START, ALL_END, quantile="exact", accuracy=RANKED_ACCURACY))


def q_outliers_ranked(spark, d):
    return outliers(_ev(spark, d), None, ALL_START, ALL_END, OUTLIER_CAP, quantile="exact", accuracy=RANKED_ACCURACY)


def q_boxplot_approx(spark, d):
    return boxplot(_ev(spark, d), ALL_START, ALL_END, bucket_ms=DAY_MS, quantile="approx", accuracy=1_000_000)


def q_outliers(spark, d):
    return outliers(_ev(spark, d), None, ALL_START, ALL_END, OUTLIER_CAP, quantile="exact")


def q_outliers_lineitem(spark, d):
    return outliers(_li(spark, d), None, ALL_START, ALL_END, OUTLIER_CAP, quantile="exact")


def q_outliers_single_channel(spark, d):
    return outliers(_ev(spark, d), ONE_CHANNEL, ALL_START, ALL_END, OUTLIER_CAP, quantile="exact")


def q_outliers_capped(spark, d):
    return outliers(_ev(spark, d), None, ALL_START, ALL_END, SMALL_CAP, quantile="exact")


def q_outliers_all(spark, d):
    return outliers(_ev(spark, d), None, ALL_START, ALL_END, None, quantile="exact")


def q_histogram_single_channel(spark, d):
    return (histogram(_ev(spark, d), ONE_CHANNEL, ALL_START, ALL_END, HIST_BINS, edges=True)
            .select("bin", "n", "lo", "hi", _r("bin_start").alias("bin_start"), _r("bin_end").alias("bin_end")))


def _gappy(spark, d):
    # the event signals with NULL values and a NULL channel in them
    return _ev(spark, d).select("ts", F.when(F.pmod("ts", F.lit(11)) != 0, F.col("channel_id")).alias("channel_id"),
                                F.when(F.pmod("ts", F.lit(7)) != 0, F.col("value")).alias("value"))


def _named_gap(boxes: DataFrame) -> DataFrame:
    return _round_box(boxes.withColumn("gk", F.coalesce("gk", F.lit(-1).cast("bigint"))))


def q_boxplot_nulls(spark, d):
    return _named_gap(boxplot(_gappy(spark, d), ALL_START, ALL_END, quantile="exact"))


def q_boxplot_nulls_ranked(spark, d):
    return _named_gap(boxplot(_gappy(spark, d), ALL_START, ALL_END, quantile="exact", accuracy=RANKED_ACCURACY))


def q_outliers_by_box(spark, d):
    sig = _ev(spark, d)
    boxes = boxplot(sig, ALL_START, ALL_END, bucket_ms=DAY_MS, quantile="exact").withColumn("label", box_label("gk"))
    pts = outliers(sig, None, ALL_START, ALL_END, OUTLIER_CAP, quantile="exact")
    return attach_outliers(pts, boxes.select("gk", "label", "n"), DAY_MS)


def q_histogram(spark, d):
    return histogram(_ev(spark, d), None, ALL_START, ALL_END, HIST_BINS)


def q_histogram_edges(spark, d):
    h = histogram(_ev(spark, d), None, ALL_START, ALL_END, HIST_BINS, edges=True)
    return h.select("channel_id", "bin", "n", "lo", "hi", _r("bin_start").alias("bin_start"),
                    _r("bin_end").alias("bin_end"))


def q_histogram_dense(spark, d):
    return histogram(_li(spark, d), None, ALL_START, ALL_END, DENSE_BINS, dense=True)


def q_overview(spark, d):
    sig, ch = event_signals(spark, d)
    return _flat_overview(overview(sig, ch))


def _flat_overview(o: DataFrame) -> DataFrame:
    return o.select("total_rows", "min_ts", "max_ts",
                    F.array_join(F.transform("channels", lambda c: F.concat(c["id"].cast("string"), F.lit(":"),
                                                                            c["name"])), ",").alias("channel_list"))


def _kept(store: SignalStore, df: DataFrame) -> DataFrame:
    """``df`` pinned, and the scratch store it was read from deleted."""
    df = materialize(df)
    delete_path(df.sparkSession, store.root)
    return df


def q_store_series_last_day(spark, d):
    # V8 on the store: a 1-day span reads L0; a 100 px chart budgets 200 points per channel
    store, _ = _loaded_store(spark, d)
    hi = store.overview().first()["max_ts"]
    out = signal_series(store.layers(), None, hi - DAY_MS, hi, pixel_width=100)
    return _kept(store, out.select("channel_id", F.col("point").alias("seq"), "ts", "value"))


def q_store_page_first(spark, d):
    store, _ = _loaded_store(spark, d)
    store.archive_before(ARCHIVE_1)
    return _kept(store, store.page(PAGE))


def q_store_page_next(spark, d):
    store, _ = _loaded_store(spark, d)
    store.archive_before(ARCHIVE_1)
    cursor, _ = next_cursor(store.page(PAGE), PAGE)
    return _kept(store, store.page(PAGE, cursor=cursor))


def q_store_overview(spark, d):
    store, _ = _loaded_store(spark, d)
    store.archive_before(ARCHIVE_1)
    return _kept(store, _flat_overview(store.overview()))


def q_store_quick_range(spark, d):
    store, _ = _loaded_store(spark, d)
    u = store.unified()
    return _kept(store, _sig_cols(between_columns(u, *quick_range(u, "1d"))))


def q_store_drill(spark, d):
    store, _ = _loaded_store(spark, d)
    u = store.unified()
    boxes = boxplot(u, ALL_START, ALL_END, bucket_ms=DAY_MS)
    busy = boxes.filter(F.col("n") > boxes.select(F.avg("n")).scalar())
    rng = drill_boxes(busy, DAY_MS).select(F.struct("start", "end")).scalar()
    return _kept(store, _sig_cols(between_columns(u, rng["start"], rng["end"])))


def q_rollup_l1(spark, d):
    return _round_rollup(rollup(_ev(spark, d), MINUTE_MS))


def q_rollup_l2(spark, d):
    return _round_rollup(rollup(_ev(spark, d), HOUR_MS))


def q_rollup_l2_from_l1(spark, d):
    return _round_rollup(rollup_from_rollup(rollup(_ev(spark, d), MINUTE_MS), HOUR_MS))


def q_rollup_lineitem_l2(spark, d):
    return _round_rollup(rollup(_li(spark, d), HOUR_MS))


def q_signal_range_l0(spark, d):
    return signal_range(_ev(spark, d), None, ALL_START, ALL_END, "L0")


def q_signal_range_l1(spark, d):
    l1 = _stable_avg(rollup(_ev(spark, d), MINUTE_MS))
    r = signal_range(l1, None, *L1_VIEW, "L1", envelope=True)
    return r.select("channel_id", "ts", _r("value").alias("value"), "min_v", "max_v")


def q_signal_range_l1_aligned(spark, d):
    l1 = _stable_avg(rollup(_ev(spark, d), MINUTE_MS))
    r = signal_range(l1, None, *L1_VIEW, "L1", align=True)
    return r.select("channel_id", "ts", _r("value").alias("value"))


def q_signal_range_l2(spark, d):
    l2 = _stable_avg(rollup(_ev(spark, d), HOUR_MS))
    r = signal_range(l2, None, *L2_VIEW, "L2")
    return r.select("channel_id", "ts", _r("value").alias("value"))


def q_signal_page_first(spark, d):
    return signal_page(_ev(spark, d), PAGE)


def q_signal_page_next(spark, d):
    sig = _ev(spark, d)
    cursor, _ = next_cursor(signal_page(sig, PAGE), PAGE)
    return signal_page(sig, PAGE, cursor=cursor)


def q_signal_page_compat(spark, d):
    sig = _li(spark, d)
    cursor, _ = next_cursor(signal_page(sig, PAGE), PAGE)
    return signal_page(sig, PAGE, cursor=cursor[0], compat=True)


def q_signal_page_lineitem_next(spark, d):
    sig = _li(spark, d)
    cursor, _ = next_cursor(signal_page(sig, PAGE), PAGE)
    return signal_page(sig, PAGE, cursor=cursor)


def q_page_numbers(spark, d):
    return assign_pages(_ev(spark, d), PAGE)


def q_minmax_preselect(spark, d):
    return minmax_preselect(_ev(spark, d), PRESELECT_BUCKETS)


def q_lttb(spark, d):
    return downsample(_ev(spark, d), 500)


def q_minmax_lttb(spark, d):
    return downsample(_ev(spark, d), 100)


def q_minmax_lttb_lineitem(spark, d):
    return downsample(_li(spark, d), 200)


def q_signal_series(spark, d):
    sig = _ev(spark, d)
    layers = {"L0": sig, "L1": _stable_avg(rollup(sig, MINUTE_MS)), "L2": _stable_avg(rollup(sig, HOUR_MS))}
    out = signal_series(layers, None, ALL_START, ALL_END, pixel_width=400)
    return out.select("channel_id", "point", "ts", _r("value").alias("value"))


def _series(layers: dict, start: int, end: int) -> DataFrame:
    # a 100 px chart: 200 points a channel, fewer than each layer has here
    out = signal_series(layers, None, start, end, pixel_width=100)
    return out.select("channel_id", F.col("point").alias("seq"), "ts", _r("value").alias("value"))


def q_signal_series_l0(spark, d):
    return _series({"L0": _ev(spark, d).withColumn("channel_id", F.lit(0))}, *SERIES_L0)


def q_signal_series_l1(spark, d):
    return _series({"L1": _stable_avg(rollup(_ev(spark, d), MINUTE_MS))}, *SERIES_L1)


def q_signal_series_l2(spark, d):
    return _series({"L2": _stable_avg(rollup(_li(spark, d), HOUR_MS))}, ALL_START, ALL_END)


def q_boxplot_panel_hours(spark, d):
    return _round_box(boxplot_panel(_ev(spark, d), None, *PANEL_DAY, quantile="exact").boxes)


def q_boxplot_panel_hours_points(spark, d):
    return boxplot_panel(_ev(spark, d), None, *PANEL_DAY, quantile="exact").points


def q_quick_range_1d(spark, d):
    sig = _ev(spark, d)
    s, e = quick_range(sig, "1d")
    return between_columns(sig, s, e)


def q_full_range(spark, d):
    sig = _ev(spark, d)
    s, e = quick_range(sig, None)
    return between_columns(sig, s, e)


def q_zoom_range(spark, d):
    sig = _ev(spark, d)
    s, e = quick_range(sig, None)
    zs, ze = zoom_columns(s, e, 25.0, 50.0)
    return between_columns(sig, zs, ze)


def q_drill_boxes(spark, d):
    sig = _ev(spark, d)
    boxes = boxplot(sig, ALL_START, ALL_END, bucket_ms=DAY_MS)
    busy = boxes.filter(F.col("n") > boxes.select(F.avg("n")).scalar())
    rng = drill_boxes(busy, DAY_MS).select(F.struct("start", "end")).scalar()
    return between_columns(sig, rng["start"], rng["end"])


def q_follow_latest(spark, d):
    sig = _ev(spark, d)
    s, e = quick_range(sig, FOLLOW_SPAN)
    return between_columns(sig, s, e)


def q_drill_box(spark, d):
    sig = _ev(spark, d)
    boxes = boxplot(sig, ALL_START, ALL_END, bucket_ms=DAY_MS)
    top = boxes.orderBy(F.col("n").desc(), F.col("gk").asc()).limit(1)
    b = top.select(F.struct(F.col("gk").alias("start"), (F.col("gk") + F.lit(DAY_MS)).alias("end"))).scalar()
    return between_columns(sig, b["start"], b["end"])


def q_box_labels(spark, d):
    boxes = boxplot(_ev(spark, d), ALL_START, ALL_END, bucket_ms=6 * HOUR_MS)
    return boxes.select("gk", box_label("gk").alias("label"), "n")


def q_boxplot_panel_boxes(spark, d):
    panel = boxplot_panel(_ev(spark, d), None, ALL_START, ALL_END, quantile="exact")
    return _round_box(panel.boxes).join(panel.boxes.select("gk", "label"), "gk")


def q_boxplot_panel_points(spark, d):
    return boxplot_panel(_ev(spark, d), None, ALL_START, ALL_END, quantile="exact", max_points=OUTLIER_CAP).points


def q_signal_range_guard(spark, d):
    return signal_range(_ev(spark, d), None, ALL_START, ALL_END, "L0", limit=GUARD)


def q_smoke_box_last_hour(spark, d):
    # the reference's smoke case: box plot by channel over the last hour of data
    sig = _ev(spark, d)
    s, e = quick_range(sig, "1h")
    return _round_box(boxplot(sig, s, e, quantile="exact"))


def q_smoke_curve_last_5min(spark, d):
    # the reference's smoke case: L0 curve over the last 5 minutes (every channel)
    sig = _ev(spark, d)
    s, e = quick_range(sig, "5m")
    return signal_range(sig, None, s, e, "L0")


def q_page_numbers_lineitem(spark, d):
    return assign_pages(_li(spark, d), PAGE)


def q_channel_labels(spark, d):
    sig, ch = event_signals(spark, d)
    return with_channel_names(sig, ch)


def q_detail_rows(spark, d):
    return detail_rows(_ev(spark, d))


def q_ensure_channels(spark, d):
    _, ch = event_signals(spark, d)
    flags = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"))
    return ensure_channels(ch, flags)


def _sig_cols(df: DataFrame) -> DataFrame:
    return df.select("ts", "channel_id", "value")


def _loaded_store(spark, d) -> tuple[SignalStore, DataFrame]:
    sig, ch = event_signals(spark, d)
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.write_channels(ch)
    store.bulk_load(sig)
    return store, sig


def q_bulk_load_l1(spark, d):
    store, _ = _loaded_store(spark, d)
    return _kept(store, _round_rollup(store.rollup_layer("L1").drop("dt")))


def _archived(spark, d, *marks) -> SignalStore:
    store, _ = _loaded_store(spark, d)
    for w in marks:
        store.archive_before(w)
    return store


def q_archive_roundtrip(spark, d):
    store = _archived(spark, d, ARCHIVE_1)
    return _kept(store, _sig_cols(store.unified()))


def q_archive_twice(spark, d):
    store = _archived(spark, d, ARCHIVE_1, ARCHIVE_2)
    return _kept(store, _sig_cols(store.unified()))


def q_archive_twice_l1(spark, d):
    store = _archived(spark, d, ARCHIVE_1, ARCHIVE_2)
    return _kept(store, _round_rollup(store.rollup_layer("L1").drop("dt")))


def q_archive_twice_l2(spark, d):
    store = _archived(spark, d, ARCHIVE_1, ARCHIVE_2)
    return _kept(store, _round_rollup(store.rollup_layer("L2").drop("dt")))


def _split_store(spark, d) -> tuple[SignalStore, DataFrame, DataFrame]:
    """An empty store, and the event signals before and from ``INCREMENT_AT`` on."""
    sig = _ev(spark, d)
    late = F.col("ts") >= INCREMENT_AT
    return SignalStore(spark, scratch_path(spark, "store")), sig.filter(~late), sig.filter(late)


def _refreshed(spark, d, layer):
    store, old, new = _split_store(spark, d)
    store.bulk_load(old)
    store.append(new)
    store.refresh_rollups(INCREMENT_AT)
    return _kept(store, _round_rollup(store.rollup_layer(layer).drop("dt")))


def q_rollup_incremental(spark, d):
    return _refreshed(spark, d, "L1")


def q_rollup_incremental_l2(spark, d):
    # L1 is current but L2 was lost: the refresh must notice
    store, old, new = _split_store(spark, d)
    store.bulk_load(old)
    store.append(new)
    delete_path(spark, store.path("l2"))
    store.refresh_rollups(0)
    return _kept(store, _round_rollup(store.rollup_layer("L2").drop("dt")))


def _unrefreshed(spark, d, layer):
    store, old, new = _split_store(spark, d)
    store.bulk_load(old)
    store.append(new)
    return _kept(store, _round_rollup(store.fresh_layer(layer).drop("dt")))


def q_fresh_rollup_l1(spark, d):
    return _unrefreshed(spark, d, "L1")


def q_fresh_rollup_l2(spark, d):
    return _unrefreshed(spark, d, "L2")


def q_archive_during_append(spark, d):
    # every row of the moved days arrives once before and once after an archive, and is moved by the next
    store, old, new = _split_store(spark, d)
    store.bulk_load(old.filter(F.col("channel_id") == 0))
    store.archive_before(ARCHIVE_1)
    store.append(new.unionByName(old.filter(F.col("channel_id") != 0)))
    store.archive_before(ARCHIVE_2)
    return _kept(store, _sig_cols(store.unified()))


def q_stream_replay_after_archive(spark, d):
    # the stream forgets its checkpointed commit after its rows were archived: the batch is replayed
    root, ckpt = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-ckpt")
    for at in range(2):
        q = start_ingest(_event_stream(spark, d), root, ckpt, trigger={"availableNow": True}, rollups=True)
        await_end(q)
        store = SignalStore(spark, root)
        if not at:
            store.archive_before(ARCHIVE_1)
            store.archive_before(ARCHIVE_2)
            for name in ("commits/0", "commits/.0.crc"):
                delete_path(spark, f"{ckpt}/{name}")
    delete_path(spark, ckpt)
    return _kept(store, _sig_cols(store.unified()))


def q_archive_result(spark, d):
    # what two archives report: rows moved, and the watermark they set
    store, _ = _loaded_store(spark, d)
    found = [store.archive_before(w) for w in (ARCHIVE_1, ARCHIVE_2, ARCHIVE_1)]
    rows = [(at, r.archived, r.rows, r.watermark) for at, r in enumerate(found)]
    return _kept(store, spark.createDataFrame(rows, "step int, archived boolean, rows bigint, watermark bigint"))


def q_store_rejects(spark, d):
    # values of one channel are lost on the way, those of another are no numbers
    sig = _ev(spark, d)
    value = F.when(F.col("channel_id") == 1, None).when(F.col("channel_id") == 2, F.lit(float("nan"))).otherwise(F.col("value"))
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.append(sig.withColumn("value", value), key="lossy")
    store.append(sig, key="lossy")                  # a retry changes nothing
    counts = [df.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_ts")).withColumn("kept", F.lit(kept))
              for df, kept in ((store.unified(), True), (store.rejects(), False))]
    return _kept(store, counts[0].unionByName(counts[1]))


def q_bulk_load_keeps_streamed(spark, d):
    store, _ = _run_ingest(spark, d)
    store.bulk_load(_ev(spark, d).limit(3))         # skipped: the store is not empty
    return _kept(store, _sig_cols(store.unified()))


def q_channels_upsert_saved(spark, d):
    _, ch = event_signals(spark, d)
    store = SignalStore(spark, scratch_path(spark, "store"))
    store.write_channels(ch)
    flags = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"))
    store.upsert_channels(flags)
    store.upsert_channels(flags)
    return _kept(store, store.channels())


def q_archive_retires_ingest(spark, d):
    # hot days left on disk after three archives: the third deletes what the second moved
    store, _ = _run_ingest(spark, d)
    for w in (ARCHIVE_1, ARCHIVE_2, ARCHIVE_2 + 5 * DAY_MS):
        store.archive_before(w)
    days = store._read("hot", SIGNAL_STORED_SCHEMA).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    return _kept(store, days.select(F.col("dt").cast("string").alias("day"), "n"))


def q_parse_rows(spark, d):
    good, _ = parse_rows(encode_rows(_ev(spark, d)))
    return good


def _event_stream(spark, d):
    events = read_table(spark, d, "events")
    _, ch = event_signals(spark, d)
    stream = file_source(spark, f"{d.rstrip('/')}/events.parquet*", events.schema)  # glob: file sources need a dir or glob
    return to_signals(stream, "ts", "event_type", "value", channels=ch)[0]


def _run_ingest(spark, d, stream=None, rollups=False):
    root = scratch_path(spark, "stream-store")
    q = start_ingest(_event_stream(spark, d) if stream is None else stream, root, f"{root}/_ckpt_ingest",
                     trigger={"availableNow": True}, rollups=rollups)
    await_end(q)
    return SignalStore(spark, root), q


def q_stream_ingest(spark, d):
    store, _ = _run_ingest(spark, d)
    return _kept(store, _sig_cols(store.unified()))


def q_stream_ingest_messages(spark, d):
    # events replayed as wire messages (JSON lines), parsed on the stream, then ingested
    inbox = scratch_path(spark, "stream-msgs")
    encode_rows(_ev(spark, d)).write.text(inbox)
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", 4).load(inbox)
    good, _ = parse_rows(raw.withColumnRenamed("value", "message"))
    store, _ = _run_ingest(spark, d, good)
    delete_path(spark, inbox)
    return _kept(store, _sig_cols(store.unified()))


def _files_stream(spark, df: DataFrame, files: int) -> tuple[DataFrame, str]:
    """``df`` written as ``files`` files and streamed one file per batch."""
    path = scratch_path(spark, "stream-files")
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return file_source(spark, path, df.schema, max_files_per_trigger=1), path


def q_stream_metrics(spark, d):
    # one batch for each of STREAM_BATCHES files, while Spark remembers two progress reports
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream, path = _files_stream(spark, _ev(spark, d), STREAM_BATCHES)
        store, _ = _run_ingest(spark, d, stream)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    delete_path(spark, path)
    return _kept(store, ingest_totals(spark, store.root))


def q_stream_metrics_totals(spark, d):
    store, _ = _run_ingest(spark, d)
    return _kept(store, ingest_totals(spark, store.root).drop("batches"))


def _run_rollup(spark, d, layer):
    store, _ = _run_ingest(spark, d, rollups=True)
    return _kept(store, _round_rollup(store.rollup_layer(layer).drop("dt")))


def q_stream_rollup_l1(spark, d):
    return _run_rollup(spark, d, "L1")


def q_stream_rollup_l2(spark, d):
    return _run_rollup(spark, d, "L2")


def _state_rollup(spark, d, layer):
    root = scratch_path(spark, "stream-store")
    start_rollup(_event_stream(spark, d), root, f"{root}/_ckpt", trigger={"availableNow": True}).awaitTermination()
    store = SignalStore(spark, root)
    return _kept(store, _round_rollup(store.rollup_layer(layer).drop("dt")))


def q_stream_state_rollup_l1(spark, d):
    return _state_rollup(spark, d, "L1")


def q_stream_state_rollup_l2(spark, d):
    return _state_rollup(spark, d, "L2")


def q_store_boxplot_sketched(spark, d):
    # day boxes from hourly sketches; a quartile is right if its rank is within SKETCH_ERROR
    store, sig = _loaded_store(spark, d)
    store.build_sketches()
    boxes = store.sketched_boxplot(ALL_START, ALL_END, bucket_ms=DAY_MS)
    ranked = sig.withColumn("gk", F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).join(boxes.select("gk", "q1", "median", "q3"), "gk")
    fine = [((F.avg((F.col("value") < F.col(q)).cast("int")) - SKETCH_ERROR <= p)
             & (F.avg((F.col("value") <= F.col(q)).cast("int")) + SKETCH_ERROR >= p)).alias(f"{q}_fine")
            for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return _kept(store, boxes.select("gk", "low", "high", "n").join(ranked.groupBy("gk").agg(*fine), "gk"))


def q_stream_rollup_repaired(spark, d):
    # newer rows first, then rows older than any lateness, after a restart from the checkpoint
    root, inbox = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-files")
    _, old, new = _split_store(spark, d)
    for at, part in enumerate((new, old)):
        part.write.parquet(f"{inbox}/{at}")
        q = start_ingest(file_source(spark, f"{inbox}/*", part.schema), root, f"{root}/_ckpt",
                         trigger={"availableNow": True}, rollups=True)
        await_end(q)
    delete_path(spark, inbox)
    store = SignalStore(spark, root)
    return _kept(store, _round_rollup(store.rollup_layer("L1").drop("dt")))


def q_stream_late_after_archive(spark, d):
    # rows of archived days arrive on the stream, before and after another archive
    root, inbox = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-files")
    store, sig = SignalStore(spark, root), _ev(spark, d)
    for at, part in enumerate((F.col("channel_id") == 0, F.col("channel_id") == 1, F.col("channel_id") > 1)):
        sig.filter(part).write.parquet(f"{inbox}/{at}")
        q = start_ingest(file_source(spark, f"{inbox}/*", sig.schema), root, f"{root}/_ckpt",
                         trigger={"availableNow": True})
        q.awaitTermination()
        store.archive_before((ARCHIVE_1, ARCHIVE_2, ARCHIVE_2)[at])
    delete_path(spark, inbox)
    return _kept(store, _sig_cols(store.unified()))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "boxplot_by_time": q_boxplot_by_time,
    "boxplot_by_channel": q_boxplot_by_channel,
    "boxplot_lineitem_week": q_boxplot_lineitem_week,
    "boxplot_by_time_ranked": q_boxplot_by_time_ranked,
    "boxplot_lineitem_ranked": q_boxplot_lineitem_ranked,
    "outliers_ranked": q_outliers_ranked,
    "boxplot_approx": q_boxplot_approx,
    "outliers": q_outliers,
    "outliers_lineitem": q_outliers_lineitem,
    "outliers_capped": q_outliers_capped,
    "outliers_all": q_outliers_all,
    "boxplot_nulls": q_boxplot_nulls,
    "boxplot_nulls_ranked": q_boxplot_nulls_ranked,
    "store_quick_range": q_store_quick_range,
    "store_drill": q_store_drill,
    "archive_during_append": q_archive_during_append,
    "stream_replay_after_archive": q_stream_replay_after_archive,
    "archive_result": q_archive_result,
    "stream_state_rollup_l1": q_stream_state_rollup_l1,
    "stream_state_rollup_l2": q_stream_state_rollup_l2,
    "store_boxplot_sketched": q_store_boxplot_sketched,
    "store_rejects": q_store_rejects,
    "bulk_load_keeps_streamed": q_bulk_load_keeps_streamed,
    "channels_upsert_saved": q_channels_upsert_saved,
    "archive_retires_ingest": q_archive_retires_ingest,
    "rollup_incremental_l2": q_rollup_incremental_l2,
    "stream_rollup_repaired": q_stream_rollup_repaired,
    "stream_late_after_archive": q_stream_late_after_archive,
    "outliers_by_box": q_outliers_by_box,
    "outliers_single_channel": q_outliers_single_channel,
    "histogram_single_channel": q_histogram_single_channel,
    "histogram": q_histogram,
    "histogram_edges": q_histogram_edges,
    "histogram_dense": q_histogram_dense,
    "overview": q_overview,
    "rollup_l1": q_rollup_l1,
    "rollup_l2": q_rollup_l2,
    "rollup_l2_from_l1": q_rollup_l2_from_l1,
    "rollup_lineitem_l2": q_rollup_lineitem_l2,
    "signal_range_l0": q_signal_range_l0,
    "signal_range_l1": q_signal_range_l1,
    "signal_range_l1_aligned": q_signal_range_l1_aligned,
    "signal_range_l2": q_signal_range_l2,
    "signal_page_first": q_signal_page_first,
    "signal_page_next": q_signal_page_next,
    "signal_page_compat": q_signal_page_compat,
    "signal_page_lineitem_next": q_signal_page_lineitem_next,
    "page_numbers": q_page_numbers,
    "minmax_preselect": q_minmax_preselect,
    "lttb": q_lttb,
    "minmax_lttb": q_minmax_lttb,
    "minmax_lttb_lineitem": q_minmax_lttb_lineitem,
    "signal_series": q_signal_series,
    "signal_series_l0": q_signal_series_l0,
    "signal_series_l1": q_signal_series_l1,
    "signal_series_l2": q_signal_series_l2,
    "boxplot_panel_hours": q_boxplot_panel_hours,
    "boxplot_panel_hours_points": q_boxplot_panel_hours_points,
    "quick_range_1d": q_quick_range_1d,
    "full_range": q_full_range,
    "zoom_range": q_zoom_range,
    "drill_boxes": q_drill_boxes,
    "follow_latest": q_follow_latest,
    "drill_box": q_drill_box,
    "box_labels": q_box_labels,
    "boxplot_panel_boxes": q_boxplot_panel_boxes,
    "boxplot_panel_points": q_boxplot_panel_points,
    "signal_range_guard": q_signal_range_guard,
    "smoke_box_last_hour": q_smoke_box_last_hour,
    "smoke_curve_last_5min": q_smoke_curve_last_5min,
    "page_numbers_lineitem": q_page_numbers_lineitem,
    "channel_labels": q_channel_labels,
    "detail_rows": q_detail_rows,
    "ensure_channels": q_ensure_channels,
    "bulk_load_l1": q_bulk_load_l1,
    "store_overview": q_store_overview,
    "store_page_first": q_store_page_first,
    "store_page_next": q_store_page_next,
    "store_series_last_day": q_store_series_last_day,
    "archive_roundtrip": q_archive_roundtrip,
    "archive_twice": q_archive_twice,
    "archive_twice_l1": q_archive_twice_l1,
    "archive_twice_l2": q_archive_twice_l2,
    "rollup_incremental": q_rollup_incremental,
    "fresh_rollup_l1": q_fresh_rollup_l1,
    "fresh_rollup_l2": q_fresh_rollup_l2,
    "parse_rows": q_parse_rows,
    "stream_ingest": q_stream_ingest,
    "stream_ingest_messages": q_stream_ingest_messages,
    "stream_metrics": q_stream_metrics,
    "stream_metrics_totals": q_stream_metrics_totals,
    "stream_rollup_l1": q_stream_rollup_l1,
    "stream_rollup_l2": q_stream_rollup_l2,
}


# ---------------------------------------------------------------------------------------------
# Oracle side (DuckDB SQL over the pre-registered driver views)
# ---------------------------------------------------------------------------------------------

_EV = """
ev_channels AS (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id, name
  FROM (SELECT DISTINCT event_type AS name FROM events) d),
signals AS (
  SELECT epoch_us(e.ts) // 1000 AS ts, c.id AS channel_id, CAST(e.value AS DOUBLE) AS value
  FROM events e JOIN ev_channels c ON e.event_type = c.name)"""

_LI = """
li_channels AS (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id, name
  FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem) d),
signals AS (
  SELECT epoch_us(l.l_shipdate) // 1000 AS ts, c.id AS channel_id, CAST(l.l_extendedprice AS DOUBLE) AS value
  FROM lineitem l JOIN li_channels c ON l.l_returnflag = c.name)"""


def _with(prelude: str, body: str) -> str:
    return f"WITH {prelude}\n{body}"


def _box_sql(prelude: str, gk: str) -> str:
    return _with(prelude, f"""
SELECT {gk} AS gk, min(value) AS low,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, count(*) AS n
FROM signals GROUP BY 1""")


def _outlier_cte(prelude: str, kept: str) -> str:
    """``kept``: points further from the quartiles' middle than twice the quartile distance, numbered by time."""
    return prelude + f""",
quart AS (SELECT channel_id, quantile_cont(value, [0.25, 0.75]) AS q FROM signals GROUP BY channel_id),
far AS (SELECT channel_id, ts, value FROM signals JOIN quart USING (channel_id)
        WHERE abs(value - (q[1] + q[2]) / 2) > 2 * (q[2] - q[1])),
{kept} AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts, value) AS nth FROM far)"""


def _outlier_sql(prelude: str, cap: int | None = None, channel: int | None = None) -> str:
    limit = "true" if cap is None else f"nth <= {cap}"
    if channel is not None:
        return _with(_outlier_cte(prelude, "pts"), f"\nSELECT ts, value FROM pts WHERE {limit} AND channel_id = {channel}")
    return _with(_outlier_cte(prelude, "pts"), f"\nSELECT channel_id, ts, value FROM pts WHERE {limit}")


def _hist_core(prelude: str, bins: int) -> str:
    """Bins by comparing every value with the ``bins - 1`` inner edges; a constant channel is above them all."""
    return prelude + f""",
b AS (SELECT channel_id, min(value) AS lo, max(value) AS hi FROM signals GROUP BY channel_id),
edges AS (SELECT channel_id, lo, hi, list_transform(range(1, {bins}), lambda k: lo + k * ((hi - lo) / {bins})) AS e FROM b),
placed AS (SELECT channel_id, lo, hi, CAST(len(list_filter(e, lambda x: x <= value)) AS INTEGER) AS bin
           FROM signals JOIN edges USING (channel_id)),
h AS (SELECT channel_id, bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM placed GROUP BY channel_id, bin)"""


_STABLE_AVG = "round(round(avg(value) * count(*), 6) / count(*), 6)"


def _rollup_sql(prelude: str, w: int, where: str = "") -> str:
    return _with(prelude, f"""
SELECT (ts // {w}) * {w} AS ts, channel_id, {_STABLE_AVG} AS avg_v, min(value) AS min_v,
       max(value) AS max_v, count(*) AS n
FROM signals {where} GROUP BY 1, 2""")


def _gappy_sql() -> str:
    return _with(_EV + """,
gappy AS (SELECT ts, CASE WHEN ts % 11 <> 0 THEN channel_id END AS channel_id, CASE WHEN ts % 7 <> 0 THEN value END AS value
          FROM signals)""", """
SELECT CAST(coalesce(channel_id, -1) AS BIGINT) AS gk, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1,
       round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, count(*) AS n
FROM gappy GROUP BY channel_id""")


def _rollup_cte(w: int) -> str:
    return f"""roll AS (SELECT (ts // {w}) * {w} AS ts, channel_id, {_STABLE_AVG} AS avg_v, min(value) AS min_v,
                     max(value) AS max_v, count(*) AS n FROM signals GROUP BY 1, 2)"""


def _extremes_cte(source: str, buckets: int) -> str:
    """``pair``: lowest and highest point of each index bucket, in index order (``k`` 0 and 1)."""
    return f"""
ext AS (SELECT channel_id, (pos * {buckets} + {buckets} - 1) // total AS b,
               arg_min({{'i': pos, 'ts': ts, 'value': value}}, (value, pos)) AS lo,
               arg_min({{'i': pos, 'ts': ts, 'value': value}}, (-value, pos)) AS hi FROM {source} GROUP BY 1, 2),
pair AS (SELECT channel_id, 2 * b + k AS i, CASE WHEN (lo.i <= hi.i) = (k = 0) THEN lo ELSE hi END AS p
         FROM ext, (VALUES (0), (1)) t(k))"""


def _downsample_sql(prelude: str, t: int, source: str = "signals") -> str:
    """MinMax + LTTB dispatch in SQL: pass-through, direct LTTB or preselect-then-LTTB per channel.

    A pick depends on the one before, so the picks are a recursive CTE over bucket numbers.
    Times count from a channel's first point, as in the operator.
    """
    inner = max(t - 2, 1)
    return f"""WITH RECURSIVE {prelude},
numbered AS (SELECT channel_id, ts, value, row_number() OVER (PARTITION BY channel_id ORDER BY ts, value) - 1 AS pos,
                    count(*) OVER (PARTITION BY channel_id) AS total FROM {source}),
large AS (SELECT * FROM numbered WHERE total > {8 * t}),{_extremes_cte("large", 4 * t)},
given AS (SELECT channel_id, pos AS i, ts, value FROM numbered WHERE total > {t} AND total <= {8 * t}
          UNION ALL SELECT channel_id, i, p.ts, p.value FROM pair),
pts AS (SELECT *, CAST(ts - min(ts) OVER (PARTITION BY channel_id) AS DOUBLE) AS x,
               count(*) OVER (PARTITION BY channel_id) AS m FROM given),
owner AS (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i = m - 1 THEN {inner} ELSE
            (SELECT max(k) FROM range({inner}) r(k) WHERE CAST(floor(k * ((m - 2) / {inner})) AS BIGINT) + 1 <= i) END AS bucket
          FROM pts WHERE m > {t} AND {t} > 2),
centre AS (SELECT channel_id, bucket, list_reduce(list(x ORDER BY i), lambda a, b: a + b) / count(*) AS cx,
                  list_reduce(list(value ORDER BY i), lambda a, b: a + b) / count(*) AS cy FROM owner GROUP BY 1, 2),
chain(channel_id, bucket, i, x, y) AS (
  SELECT channel_id, -1, i, x, value FROM owner WHERE bucket = -1
  UNION ALL
  SELECT w.channel_id, w.bucket, w.best.i, w.best.x, w.best.y FROM (
    SELECT o.channel_id, o.bucket, arg_min({{'i': o.i, 'x': o.x, 'y': o.value}},
             (-abs((o.x - c.x) * (n.cy - c.y) - (o.value - c.y) * (n.cx - c.x)), o.i)) AS best
    FROM chain c JOIN owner o ON o.channel_id = c.channel_id AND o.bucket = c.bucket + 1
    JOIN centre n ON n.channel_id = c.channel_id AND n.bucket = c.bucket + 2
    GROUP BY o.channel_id, o.bucket) w),
final AS (SELECT channel_id, bucket + 1 AS seq, i FROM chain
          UNION ALL SELECT channel_id, {t} - 1, i FROM owner WHERE bucket = {inner})
SELECT channel_id, CAST(pos AS BIGINT) AS seq, ts, value FROM numbered WHERE total <= {t}
UNION ALL
SELECT channel_id, CAST(i AS BIGINT) AS seq, ts, value FROM pts WHERE m <= {t} OR {t} <= 2
UNION ALL
SELECT channel_id, CAST(seq AS BIGINT) AS seq, ts, value FROM final JOIN pts USING (channel_id, i)"""


_ORDER = "ORDER BY ts DESC, channel_id, value"

_OVERVIEW_SQL = _with(_EV, """
SELECT (SELECT count(*) FROM signals) AS total_rows, (SELECT min(ts) FROM signals) AS min_ts,
       (SELECT max(ts) FROM signals) AS max_ts,
       (SELECT string_agg(CAST(id AS VARCHAR) || ':' || name, ',' ORDER BY id) FROM ev_channels) AS channel_list""")

_SQL: dict[str, str] = {
    "boxplot_by_time": _box_sql(_EV, f"(ts // {DAY_MS}) * {DAY_MS}"),
    "boxplot_by_channel": _box_sql(_EV, "CAST(channel_id AS BIGINT)"),
    "boxplot_lineitem_week": _box_sql(_LI, f"(ts // {7 * DAY_MS}) * {7 * DAY_MS}"),
    "boxplot_by_time_ranked": _box_sql(_EV, f"(ts // {DAY_MS}) * {DAY_MS}"),
    "boxplot_lineitem_ranked": _box_sql(_LI, "CAST(channel_id AS BIGINT)"),
    "outliers_ranked": _outlier_sql(_EV),
    "boxplot_approx": _with(_EV, f"""
SELECT (ts // {DAY_MS}) * {DAY_MS} AS gk, min(value) AS low, quantile_disc(value, 0.25) AS q1,
       quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q3, max(value) AS high, count(*) AS n
FROM signals GROUP BY 1"""),
    "outliers": _outlier_sql(_EV, OUTLIER_CAP),
    "outliers_lineitem": _outlier_sql(_LI, OUTLIER_CAP),
    "outliers_capped": _outlier_sql(_EV, SMALL_CAP),
    "outliers_all": _outlier_sql(_EV),
    "outliers_by_box": _with(_outlier_cte(_EV, "pts"), f"""
, boxes AS (SELECT ts - ts % {DAY_MS} AS gk, count(*) AS n FROM signals GROUP BY 1)
SELECT b.gk, p.channel_id, p.ts, p.value, strftime(make_timestamp(b.gk * 1000), '%m-%d %H:%M') AS label, b.n
FROM pts p JOIN boxes b ON p.ts - p.ts % {DAY_MS} = b.gk WHERE p.nth <= {OUTLIER_CAP}"""),
    "histogram": _with(_hist_core(_EV, HIST_BINS), "\nSELECT channel_id, bin, n, lo, hi FROM h"),
    "histogram_single_channel": _with(_hist_core(_EV, HIST_BINS), f"""
SELECT bin, n, lo, hi, round(lo + bin * ((hi - lo) / {HIST_BINS}), 6) AS bin_start,
       round(lo + (bin + 1) * ((hi - lo) / {HIST_BINS}), 6) AS bin_end FROM h WHERE channel_id = {ONE_CHANNEL}"""),
    "outliers_single_channel": _outlier_sql(_EV, OUTLIER_CAP, ONE_CHANNEL),
    "histogram_edges": _with(_hist_core(_EV, HIST_BINS), f"""
SELECT channel_id, bin, n, lo, hi, round(lo + bin * ((hi - lo) / {HIST_BINS}), 6) AS bin_start,
       round(lo + (bin + 1) * ((hi - lo) / {HIST_BINS}), 6) AS bin_end FROM h"""),
    "histogram_dense": _with(_hist_core(_LI, DENSE_BINS) + f""",
grid AS (SELECT b.channel_id, CAST(g.bin AS INTEGER) AS bin, b.lo, b.hi
         FROM b, range(0, {DENSE_BINS}) g(bin))""", """
SELECT g.channel_id, g.bin, coalesce(h.n, 0) AS n, g.lo, g.hi
FROM grid g LEFT JOIN h ON g.channel_id = h.channel_id AND g.bin = h.bin"""),
    "overview": _OVERVIEW_SQL,
    "rollup_l1": _rollup_sql(_EV, MINUTE_MS),
    "rollup_l2": _rollup_sql(_EV, HOUR_MS),
    "rollup_l2_from_l1": _rollup_sql(_EV, HOUR_MS),
    "rollup_lineitem_l2": _rollup_sql(_LI, HOUR_MS),
    "signal_range_l0": _with(_EV, "\nSELECT channel_id, ts, value FROM signals"),
    "signal_range_l1": _with(_EV + ",\n" + _rollup_cte(MINUTE_MS), f"""
SELECT channel_id, ts, round(avg_v, 6) AS value, min_v, max_v FROM roll
WHERE ts BETWEEN {L1_VIEW[0]} AND {L1_VIEW[1]}"""),
    "signal_range_l1_aligned": _with(_EV + ",\n" + _rollup_cte(MINUTE_MS), f"""
SELECT channel_id, ts, round(avg_v, 6) AS value FROM roll
WHERE ts BETWEEN {L1_VIEW[0] - L1_VIEW[0] % MINUTE_MS} AND {L1_VIEW[1]}"""),
    "signal_range_l2": _with(_EV + ",\n" + _rollup_cte(HOUR_MS), f"""
SELECT channel_id, ts, round(avg_v, 6) AS value FROM roll
WHERE ts BETWEEN {L2_VIEW[0]} AND {L2_VIEW[1]}"""),
    "signal_page_first": _with(_EV, f"\nSELECT ts, channel_id, value FROM signals {_ORDER} LIMIT {PAGE}"),
    "signal_page_next": _with(_EV, f"\nSELECT ts, channel_id, value FROM signals {_ORDER} LIMIT {PAGE} OFFSET {PAGE}"),
    "signal_page_compat": _with(_LI + f""",
first_page AS (SELECT ts FROM signals {_ORDER} LIMIT {PAGE})""", f"""
SELECT ts, channel_id, value FROM signals WHERE ts < (SELECT min(ts) FROM first_page) {_ORDER} LIMIT {PAGE}"""),
    "signal_page_lineitem_next": _with(_LI, f"""
SELECT ts, channel_id, value FROM signals {_ORDER} LIMIT {PAGE} OFFSET {PAGE}"""),
    "page_numbers": _with(_EV, f"""
SELECT ts, channel_id, value, CAST((rn - 1) // {PAGE} AS BIGINT) AS page, CAST((rn - 1) % {PAGE} AS BIGINT) AS pos
FROM (SELECT *, row_number() OVER ({_ORDER}) AS rn FROM signals) t"""),
    "minmax_preselect": _with(_EV + f""",
numbered AS (SELECT channel_id, ts, value, row_number() OVER (PARTITION BY channel_id ORDER BY ts, value) - 1 AS pos,
                    count(*) OVER (PARTITION BY channel_id) AS total FROM signals),
large AS (SELECT * FROM numbered WHERE total > {2 * PRESELECT_BUCKETS}),{_extremes_cte("large", PRESELECT_BUCKETS)}""", f"""
SELECT channel_id, CAST(i AS BIGINT) AS seq, p.ts AS ts, p.value AS value FROM pair
UNION ALL
SELECT channel_id, CAST(pos AS BIGINT) AS seq, ts, value FROM numbered WHERE total <= {2 * PRESELECT_BUCKETS}"""),
    "lttb": _downsample_sql(_EV, 500),
    "minmax_lttb": _downsample_sql(_EV, 100),
    "minmax_lttb_lineitem": _downsample_sql(_LI, 200),
    # Whole-data span -> L2 layer; each channel's hour series fits the 800-point budget.
    "signal_series": _with(_EV + ",\n" + _rollup_cte(HOUR_MS), """
SELECT channel_id, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY ts, avg_v) - 1 AS BIGINT) AS point,
       ts, round(avg_v, 6) AS value FROM roll"""),
    "signal_series_l0": _downsample_sql(_EV + f""",
view AS (SELECT CAST(0 AS INTEGER) AS channel_id, ts, value FROM signals WHERE ts BETWEEN {SERIES_L0[0]} AND {SERIES_L0[1]})""", 200, "view"),
    "signal_series_l1": _downsample_sql(_EV + ",\n" + _rollup_cte(MINUTE_MS) + f""",
view AS (SELECT channel_id, ts, avg_v AS value FROM roll WHERE ts BETWEEN {SERIES_L1[0]} AND {SERIES_L1[1]})""", 200, "view"),
    "signal_series_l2": _downsample_sql(_LI + ",\n" + _rollup_cte(HOUR_MS) + """,
view AS (SELECT channel_id, ts, avg_v AS value FROM roll)""", 200, "view"),
    "boxplot_panel_hours": _box_sql(_EV + f""",
day AS (SELECT * FROM signals WHERE ts BETWEEN {PANEL_DAY[0]} AND {PANEL_DAY[1]})""", f"ts - ts % {HOUR_MS}").replace("FROM signals GROUP", "FROM day GROUP"),
    "boxplot_panel_hours_points": _with(_outlier_cte(_EV.replace("signals AS (", "every AS (") + f""",
signals AS (SELECT * FROM every WHERE ts BETWEEN {PANEL_DAY[0]} AND {PANEL_DAY[1]})""", "pts"), f"""
SELECT ts - ts % {HOUR_MS} AS gk, channel_id, ts, value,
       strftime(make_timestamp((ts - ts % {HOUR_MS}) * 1000), '%m-%d %H:%M') AS label FROM pts"""),
    "quick_range_1d": _with(_EV, f"""
SELECT * FROM signals WHERE ts BETWEEN (SELECT max(ts) FROM signals) - {DAY_MS} AND (SELECT max(ts) FROM signals)"""),
    "full_range": _with(_EV, "\nSELECT * FROM signals"),
    "zoom_range": _with(_EV + """,
bd AS (SELECT min(ts) AS s, max(ts) AS e FROM signals),
z AS (SELECT CAST(floor(s + 0.25 * (e - s) + 0.5) AS BIGINT) AS zs,
             CAST(floor(s + 0.5 * (e - s) + 0.5) AS BIGINT) AS ze FROM bd)""", """
SELECT s.* FROM signals s, z WHERE s.ts BETWEEN z.zs AND z.ze"""),
    "drill_boxes": _with(_EV + f""",
boxes AS (SELECT (ts // {DAY_MS}) * {DAY_MS} AS gk, count(*) AS n FROM signals GROUP BY 1),
busy AS (SELECT gk FROM boxes WHERE n > (SELECT avg(n) FROM boxes)),
rng AS (SELECT min(gk) AS s, max(gk) + {DAY_MS} AS e FROM busy)""", """
SELECT s.* FROM signals s, rng WHERE s.ts BETWEEN rng.s AND rng.e"""),
    "follow_latest": _with(_EV, f"""
SELECT * FROM signals WHERE ts BETWEEN (SELECT max(ts) FROM signals) - {FOLLOW_SPAN} AND (SELECT max(ts) FROM signals)"""),
    "drill_box": _with(_EV + f""",
boxes AS (SELECT (ts // {DAY_MS}) * {DAY_MS} AS gk, count(*) AS n FROM signals GROUP BY 1),
top AS (SELECT gk FROM boxes ORDER BY n DESC, gk LIMIT 1)""", f"""
SELECT s.* FROM signals s, top WHERE s.ts BETWEEN top.gk AND top.gk + {DAY_MS}"""),
    "box_labels": _with(_EV, f"""
SELECT (ts // {6 * HOUR_MS}) * {6 * HOUR_MS} AS gk,
       strftime(make_timestamp(((ts // {6 * HOUR_MS}) * {6 * HOUR_MS}) * 1000), '%m-%d %H:%M') AS label,
       count(*) AS n
FROM signals GROUP BY 1, 2"""),
    "boxplot_panel_boxes": _with(_EV, f"""
SELECT (ts // {WEEK_MS}) * {WEEK_MS} AS gk, min(value) AS low,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, count(*) AS n,
       strftime(make_timestamp(((ts // {WEEK_MS}) * {WEEK_MS}) * 1000), '%m-%d %H:%M') AS label
FROM signals GROUP BY 1, 8"""),
    "boxplot_panel_points": _with(_outlier_cte(_EV, "pts"), f"""
SELECT ts - ts % {WEEK_MS} AS gk, channel_id, ts, value,
       strftime(make_timestamp((ts - ts % {WEEK_MS}) * 1000), '%m-%d %H:%M') AS label
FROM pts WHERE nth <= {OUTLIER_CAP}"""),
    "signal_range_guard": _with(_EV, f"""
SELECT channel_id, ts, value FROM signals QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY ts, value) <= {GUARD}"""),
    "boxplot_nulls": _gappy_sql(),
    "boxplot_nulls_ranked": _gappy_sql(),
    "store_quick_range": _with(_EV, f"""
SELECT * FROM signals WHERE ts >= (SELECT max(ts) FROM signals) - {DAY_MS}"""),
    "store_drill": _with(_EV + f""",
days AS (SELECT ts - ts % {DAY_MS} AS day, count(*) AS n FROM signals GROUP BY 1),
span AS (SELECT min(day) AS s, max(day) + {DAY_MS} AS e FROM days WHERE n > (SELECT avg(n) FROM days))""", """
SELECT signals.* FROM signals, span WHERE ts BETWEEN s AND e"""),
    "archive_during_append": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "bulk_load_keeps_streamed": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "stream_late_after_archive": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "channels_upsert_saved": _with(_EV + """,
fresh AS (SELECT DISTINCT l_returnflag AS name FROM lineitem WHERE l_returnflag NOT IN (SELECT name FROM ev_channels))""", """
SELECT id, name FROM ev_channels
UNION ALL
SELECT CAST((SELECT count(*) FROM ev_channels) + row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id, name FROM fresh"""),
    "archive_retires_ingest": _with(_EV, f"""
SELECT strftime(make_timestamp((ts - ts % {DAY_MS}) * 1000), '%Y-%m-%d') AS day, count(*) AS n
FROM signals WHERE ts >= {ARCHIVE_2 - ARCHIVE_2 % DAY_MS} GROUP BY 1"""),
    "rollup_incremental_l2": _rollup_sql(_EV, HOUR_MS),
    "stream_rollup_repaired": _rollup_sql(_EV, MINUTE_MS),
    "stream_metrics": _with(_EV, f"""
SELECT count(*) AS rows_ingested, max(ts) AS max_ts, CAST({STREAM_BATCHES} AS BIGINT) AS batches FROM signals"""),
    "smoke_box_last_hour": _with(_EV, f"""
SELECT CAST(channel_id AS BIGINT) AS gk, min(value) AS low,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high, count(*) AS n
FROM signals WHERE ts BETWEEN (SELECT max(ts) FROM signals) - {HOUR_MS} AND (SELECT max(ts) FROM signals)
GROUP BY 1"""),
    "smoke_curve_last_5min": _with(_EV, f"""
SELECT channel_id, ts, value FROM signals
WHERE ts BETWEEN (SELECT max(ts) FROM signals) - 300000 AND (SELECT max(ts) FROM signals)"""),
    "page_numbers_lineitem": _with(_LI, f"""
SELECT ts, channel_id, value, CAST((rn - 1) // {PAGE} AS BIGINT) AS page, CAST((rn - 1) % {PAGE} AS BIGINT) AS pos
FROM (SELECT *, row_number() OVER ({_ORDER}) AS rn FROM signals) t"""),
    "channel_labels": _with(_EV, """
SELECT s.channel_id, s.ts, s.value, c.name AS channel_name FROM signals s LEFT JOIN ev_channels c ON s.channel_id = c.id"""),
    "detail_rows": _with(_EV, """
SELECT ts, channel_id, value, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS time_text,
       'CH-' || CAST(channel_id AS VARCHAR) AS channel_label, printf('%.3f', value) AS value_text,
       CAST(ts AS VARCHAR) || '-' || CAST(channel_id AS VARCHAR) AS row_key FROM signals"""),
    "ensure_channels": """
WITH ev AS (SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id, name
            FROM (SELECT DISTINCT event_type AS name FROM events) d),
new AS (SELECT DISTINCT l_returnflag AS name FROM lineitem WHERE l_returnflag NOT IN (SELECT name FROM ev))
SELECT id, name FROM ev
UNION ALL
SELECT CAST((SELECT max(id) + 1 FROM ev) + row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS id, name FROM new""",
    "bulk_load_l1": _rollup_sql(_EV, MINUTE_MS),
    "store_overview": _OVERVIEW_SQL,
    "store_page_first": _with(_EV, f"\nSELECT ts, channel_id, value FROM signals {_ORDER} LIMIT {PAGE}"),
    "store_page_next": _with(_EV, f"\nSELECT ts, channel_id, value FROM signals {_ORDER} LIMIT {PAGE} OFFSET {PAGE}"),
    "store_series_last_day": _downsample_sql(_EV + f""",
last_day AS (SELECT * FROM signals
             WHERE ts BETWEEN (SELECT max(ts) FROM signals) - {DAY_MS} AND (SELECT max(ts) FROM signals))""",
                                             200, source="last_day"),
    "archive_roundtrip": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "archive_twice": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "stream_state_rollup_l1": _rollup_sql(_EV, MINUTE_MS),
    "stream_state_rollup_l2": _rollup_sql(_EV, HOUR_MS),
    "store_boxplot_sketched": _with(_EV, f"""
SELECT (ts // {DAY_MS}) * {DAY_MS} AS gk, min(value) AS low, max(value) AS high, count(*) AS n,
       true AS q1_fine, true AS median_fine, true AS q3_fine FROM signals GROUP BY 1"""),
    "archive_result": _with(_EV, f"""
SELECT CAST(0 AS INTEGER) AS step, true AS archived, count(*) AS rows, CAST({ARCHIVE_1 - ARCHIVE_1 % DAY_MS} AS BIGINT) AS watermark
FROM signals WHERE ts < {ARCHIVE_1 - ARCHIVE_1 % DAY_MS}
UNION ALL
SELECT 1, true, count(*), {ARCHIVE_2} FROM signals WHERE ts >= {ARCHIVE_1 - ARCHIVE_1 % DAY_MS} AND ts < {ARCHIVE_2}
UNION ALL
SELECT 2, false, 0, {ARCHIVE_2}"""),
    "store_rejects": _with(_EV, """
SELECT channel_id, count(*) AS n, count(ts) AS n_ts, channel_id NOT IN (1, 2) AS kept FROM signals GROUP BY channel_id"""),
    "stream_replay_after_archive": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "archive_twice_l1": _rollup_sql(_EV, MINUTE_MS),
    "archive_twice_l2": _rollup_sql(_EV, HOUR_MS),
    "rollup_incremental": _rollup_sql(_EV, MINUTE_MS),
    "fresh_rollup_l1": _rollup_sql(_EV, MINUTE_MS),
    "fresh_rollup_l2": _rollup_sql(_EV, HOUR_MS),
    "parse_rows": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "stream_ingest": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "stream_ingest_messages": _with(_EV, "\nSELECT ts, channel_id, value FROM signals"),
    "stream_metrics_totals": _with(_EV, "\nSELECT count(*) AS rows_ingested, max(ts) AS max_ts FROM signals"),
    "stream_rollup_l1": _rollup_sql(_EV, MINUTE_MS),
    "stream_rollup_l2": _rollup_sql(_EV, HOUR_MS),
}


try:
    import corpus_pipeline
    import sigstrata.llm.queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "sigstrata.llm"):
        raise
    corpus_pipeline = llm_queries = None

if llm_queries is not None:
    _QUERIES.update(llm_queries.QUERIES)
    _QUERIES["pipeline"] = corpus_pipeline.run
    _SQL.update(llm_queries.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        _SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: box plot by 1-day bucket over all event signals, exact quartiles (Q3)."""
    return q_boxplot_by_time(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _SQL.items() if k in _QUERIES}
