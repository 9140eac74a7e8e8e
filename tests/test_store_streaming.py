"""Store (S2-S10, R3-R5), payload parsing (S6) and streaming jobs."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from sigstrata.operators import rollup
from sigstrata.schemas import DAY_MS, HOUR_MS, MINUTE_MS
from sigstrata.session import scratch_path
from sigstrata.sources.adapters import channel_dictionary, ensure_channels
from sigstrata.sources.ingest import parse_rows
from sigstrata.sources.store import SignalStore
from sigstrata.streaming.jobs import await_end, file_source, ingest_metrics, rollup_stream, start_ingest, start_rollup

from .conftest import sorted_rows

D0 = 19_000 * DAY_MS      # a UTC midnight


def _five_days(make_sig):
    rows = [(D0 + d * DAY_MS + h * HOUR_MS + c * 7, c, float(d * 100 + h + c)) for d in range(5) for h in
            range(0, 24, 3) for c in range(2)]
    return make_sig(rows), rows


def _rollup_rows(df):
    return sorted_rows(df.select("ts", "channel_id", F.round("avg_v", 9).alias("a"), "min_v", "max_v", "n"))


def test_archive_two_steps_keeps_view_and_rollups(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-store"))
    assert store.bulk_load(sig) is True
    assert store.bulk_load(sig) is False                       # skip_if_nonempty
    want_l1 = _rollup_rows(rollup(sig, MINUTE_MS))
    r1 = store.archive_before(D0 + 2 * DAY_MS + 5 * HOUR_MS)    # aligned down to day 2
    assert r1.archived and r1.watermark == D0 + 2 * DAY_MS and r1.rows == 2 * 8 * 2
    r2 = store.archive_before(D0 + 4 * DAY_MS)
    assert r2.archived and r2.rows == 2 * 8 * 2
    assert store.archive_before(D0 + 3 * DAY_MS).archived is False   # behind the watermark
    assert sorted_rows(store.unified().select("ts", "channel_id", "value")) == sorted(rows)
    assert _rollup_rows(store.rollup_layer("L1")) == want_l1
    assert _rollup_rows(store.rollup_layer("L2")) == _rollup_rows(rollup(sig, HOUR_MS))
    hot_days = [name for _, batch in store._folders(store.path("hot"), "batch=") for name, _ in store._folders(batch, "dt=")]
    # days moved by the first archive are dropped by the second; those moved by the second stay
    # (hidden) until the next archive, so relations built before it remain readable
    assert hot_days == ["dt=2022-01-10", "dt=2022-01-11", "dt=2022-01-12"]


class _Stopped(Exception):
    pass


def _stop(*_):
    raise _Stopped


def test_archive_crash_before_commit_has_no_duplicates(spark, make_sig, monkeypatch):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-crash"))
    store.bulk_load(sig)
    with monkeypatch.context() as m:
        m.setattr(SignalStore, "_commit", _stop)
        with pytest.raises(_Stopped):
            store.archive_before(D0 + 2 * DAY_MS)
    assert store.watermark() is None and _all(store) == sorted(rows)
    store.archive_before(D0 + 2 * DAY_MS)                      # what the crash left is no part of the retry
    assert _all(store) == sorted(rows) and store._folders(f"{store.root}/_staged", "") == []


def test_two_archives_that_stop_before_cleaning_double_nothing(spark, make_sig, monkeypatch):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-crash2"))
    store.bulk_load(sig)
    store.archive_before(D0 + DAY_MS)
    with monkeypatch.context() as m:
        m.setattr("sigstrata.sources.store.delete_path", _stop)         # nothing gets deleted any more
        for day in (2, 3):
            m.setattr(SignalStore, "_clean", lambda self: None)
            store.archive_before(D0 + day * DAY_MS)
            assert _all(store) == sorted(rows)
    store.archive_before(D0 + 4 * DAY_MS)                      # deletes what the three before have moved
    assert _all(store) == sorted(rows)
    days = [name for _, batch in store._folders(store.path("hot"), "batch=") for name, _ in store._folders(batch, "dt=")]
    assert days == ["dt=2022-01-11", "dt=2022-01-12"]


def test_an_append_during_an_archive_is_kept_and_moved_by_the_next(spark, make_sig, monkeypatch):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-race"))
    store.bulk_load(sig.filter("channel_id = 0"))
    commit = SignalStore._commit

    def racing(self, *args):
        monkeypatch.setattr(SignalStore, "_commit", commit)
        self.append(sig.filter("channel_id = 1"))
        commit(self, *args)

    monkeypatch.setattr(SignalStore, "_commit", racing)
    store.archive_before(D0 + 2 * DAY_MS)
    assert _all(store) == sorted(rows)
    store.archive_before(D0 + 3 * DAY_MS)
    assert _all(store) == sorted(rows) and store.cold().count() == len([r for r in rows if r[0] < D0 + 3 * DAY_MS])


def test_keyed_append_retried_after_its_archive_is_stored_once(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-key-archive"))
    for day in (2, 3, 4):
        store.append(sig, key="load-1")
        store.archive_before(D0 + day * DAY_MS)
        assert _all(store) == sorted(rows)
    store.append(sig, key="load-1")
    assert _all(store) == sorted(rows) and not store.holds("load-2")


def test_a_crash_inside_a_replacement_leaves_the_old_rows(spark, make_sig, monkeypatch):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-crash3"))
    store.bulk_load(sig)
    for step in ("rebuild_rollups", "_rename"):
        with monkeypatch.context() as m:
            calls = getattr(SignalStore, step)
            m.setattr(SignalStore, step, lambda self, *a: _stop() if step != "_rename" or "/g=" in a[1].rsplit("/", 1)[1:][0] or a[1].endswith("g=000001") else calls(self, *a))
            with pytest.raises(_Stopped):
                store.bulk_load(make_sig([(D0, 9, 1.0)]), mode="overwrite")
        assert _all(store) == sorted(rows)
    old = store.unified()
    store.bulk_load(make_sig([(D0, 9, 1.0)]), mode="overwrite")
    assert _all(store) == [(D0, 9, 1.0)] and old.count() == len(rows)        # relations of the old rows still read
    store.bulk_load(make_sig([]), mode="overwrite")
    assert _all(store) == [] and store.overview().first()["total_rows"] == 0


def test_one_new_row_recomputes_one_hour(spark, make_sig, monkeypatch):
    rows = [(D0 + i * 1000, i % 2, float(i % 11)) for i in range(86_400)]
    store = SignalStore(spark, scratch_path(spark, "t-delta"))
    store.bulk_load(make_sig(rows))
    new = [(D0 + 7 * HOUR_MS + 5, 0, 99.0)]
    store.append(make_sig(new))
    counted, plain = [], rollup
    monkeypatch.setattr("sigstrata.sources.store.rollup", lambda df, w: counted.append(df.count()) or plain(df, w))
    assert [str(d) for d in store.refresh_rollups(D0)] == ["2022-01-08"] and counted == [3601]
    assert store.refresh_rollups(D0) == [] and counted == [3601]
    monkeypatch.undo()
    for layer, width in (("L1", MINUTE_MS), ("L2", HOUR_MS)):
        assert _rollup_rows(store.rollup_layer(layer)) == _rollup_rows(rollup(make_sig(rows + new), width))


def test_stream_refreshes_rollups_at_most_every_five_seconds(spark, make_sig, monkeypatch):
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-throttle")
    rows = [(D0 + i * HOUR_MS + 1, 0, float(i)) for i in range(6)]
    for i, r in enumerate(rows):
        make_sig([r]).coalesce(1).write.parquet(f"{src}/{i}")
    calls, plain = [], SignalStore.refresh_hours
    monkeypatch.setattr(SignalStore, "refresh_hours", lambda self, hours: calls.append(len(hours)) or plain(self, hours))
    store = _ingest_all(spark, file_source(spark, f"{src}/*", make_sig([]).schema, max_files_per_trigger=1), root, rollups=True, refresh_every=1000.0)
    assert calls == [1, 5]              # the first batch, and what was left at the end
    assert _rollup_rows(store.rollup_layer("L1")) == _rollup_rows(rollup(make_sig(rows), MINUTE_MS))


def test_rollups_that_a_crash_left_are_finished_after_the_restart(spark, make_sig, monkeypatch):
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-unrolled")
    rows = [(D0 + i * DAY_MS, 0, float(i)) for i in range(3)]
    make_sig(rows[:2]).coalesce(1).write.parquet(f"{src}/0")
    stream = lambda: file_source(spark, f"{src}/*", make_sig([]).schema)
    with monkeypatch.context() as m:
        m.setattr("sigstrata.streaming.jobs._Ingest.finish", lambda self, spark: None)      # stored, never rolled up
        _ingest_all(spark, stream(), root, rollups=True)
    make_sig(rows[2:]).coalesce(1).write.parquet(f"{src}/1")
    store = _ingest_all(spark, stream(), root, rollups=True)
    assert _rollup_rows(store.rollup_layer("L2")) == _rollup_rows(rollup(make_sig(rows), HOUR_MS))


def test_many_small_batches_are_listed_fast(spark, make_sig):
    import time
    root = scratch_path(spark, "t-many")
    store = SignalStore(spark, root)
    store.append(make_sig([(D0, 0, 1.0)]), key="k0")
    first = store._folders(store.path("hot"), "batch=")[0][1].removeprefix("file:")
    for i in range(1, 600):
        shutil.copytree(first, f"{first[:-1]}{i}")
    store.unified().count()
    began = time.time()
    assert store.unified().select("ts").count() == 600
    assert time.time() - began < 10 and len(store.unified().inputFiles()) == 600


def test_partition_pruning_on_store(spark, make_sig):
    sig, _ = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-prune"))
    store.bulk_load(sig)
    from sigstrata.operators import in_range
    plan = in_range(store.hot(), D0 + DAY_MS, D0 + DAY_MS + HOUR_MS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_incremental_refresh_equals_full(spark, make_sig):
    sig, _ = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-incr"))
    cut = D0 + 3 * DAY_MS + 2 * HOUR_MS
    store.bulk_load(sig.filter(F.col("ts") < cut))
    store.append(sig.filter(F.col("ts") >= cut))
    days = store.refresh_rollups(cut)
    assert len(days) == 2
    assert _rollup_rows(store.rollup_layer("L1")) == _rollup_rows(rollup(sig, MINUTE_MS))
    assert store.refresh_rollups(cut) == []                     # nothing new: nothing rewritten


def test_ensure_channels_insert_or_ignore(spark):
    ch = channel_dictionary(spark.createDataFrame([("b",), ("a",)], "name string"))
    out = ensure_channels(ch, spark.createDataFrame([("a",), ("c",), (None,), ("c",)], "name string"))
    assert sorted_rows(out) == [(0, "a"), (1, "b"), (2, "c")]


def test_bad_rows_go_to_reject_output(spark):
    msgs = [json.dumps({"rows": [[1, 0, 1.5], [2, 1, "x"], [None, 0, 1.0], [3, 0]]}), "not json",
            json.dumps({"rows": [[4, 2, "7.25"]]})]
    good, bad = parse_rows(spark.createDataFrame([(m,) for m in msgs], "message string"))
    assert sorted_rows(good) == [(1, 0, 1.5), (4, 2, 7.25)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad ts", "bad value", "expected 3 fields",
                                                          "unparsable message"]


def _stream_dir(spark, make_sig, rows):
    src = scratch_path(spark, "t-src")
    make_sig(rows).coalesce(1).write.parquet(src)
    return src


def test_stream_ingest_and_metrics(spark, make_sig):
    rows = [(D0 + i * 1000, i % 3, float(i)) for i in range(500)]
    src = _stream_dir(spark, make_sig, rows)
    root = scratch_path(spark, "t-ingest")
    stream = file_source(spark, src, make_sig([]).schema, max_files_per_trigger=1)
    q = start_ingest(stream, root, f"{root}/_ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    assert sorted_rows(SignalStore(spark, root).unified().select("ts", "channel_id", "value")) == sorted(rows)
    m = [r for r in ingest_metrics(spark, q).collect() if r["num_input_rows"] > 0]
    assert sum(r["observed_count"] for r in m) == 500 and max(r["observed_max_ts"] for r in m) == D0 + 499_000


def test_rollups_as_stream_state_drop_late_rows_and_read_no_rows(spark, make_sig, monkeypatch):
    # minute rows over 3 hours, then a row 30 min late (kept) and one 2 h late (dropped)
    rows = [(D0 + i * 10_000, 0, 1.0) for i in range(3 * 360)]
    late_ok, late_bad = (D0 + 3 * HOUR_MS - 30 * MINUTE_MS, 0, 100.0), (D0 + 5_000, 0, 100.0)
    src, root, schema = scratch_path(spark, "t-late"), scratch_path(spark, "t-roll"), make_sig([]).schema
    monkeypatch.setattr(SignalStore, "unified", _stop)              # L0 is not read
    for part, new in enumerate((rows, [late_ok, late_bad, (D0 + 4 * HOUR_MS, 0, 1.0)])):
        make_sig(new).coalesce(1).write.parquet(f"{src}/{part}")
        q = start_rollup(file_source(spark, f"{src}/*", schema), root, f"{root}/_ckpt", trigger={"availableNow": True})
        q.awaitTermination()
    store = SignalStore(spark, root)
    kept = make_sig([*rows, late_ok, (D0 + 4 * HOUR_MS, 0, 1.0)])
    for layer, width in (("L1", MINUTE_MS), ("L2", HOUR_MS)):
        assert _rollup_rows(store.rollup_layer(layer)) == _rollup_rows(rollup(kept, width))
    assert sum(r["rows_dropped_by_watermark"] for r in ingest_metrics(spark, q).collect()) == 1


def test_state_of_the_rollup_stream_is_bounded(spark, make_sig):
    src, root = scratch_path(spark, "t-state"), scratch_path(spark, "t-roll")
    rows = [(D0 + i * MINUTE_MS, c, float(i)) for i in range(12 * 60) for c in range(2)]
    for part in range(6):                                            # two hours a batch
        make_sig(rows[part * 240:(part + 1) * 240]).coalesce(1).write.parquet(f"{src}/{part}")
    q = start_rollup(file_source(spark, f"{src}/*", make_sig([]).schema, max_files_per_trigger=1), root, f"{root}/_ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert held[-1] <= 2 * (60 + 120) < len(rows)                   # an hour of lateness and a batch, of two channels
    assert _rollup_rows(SignalStore(spark, root).rollup_layer("L2")) == _rollup_rows(rollup(make_sig(rows), HOUR_MS))


def test_box_plot_from_sketches_reads_no_rows(spark, make_sig):
    import random
    rnd = random.Random(6)
    rows = [(D0 + i * 20_000, i % 2, rnd.choice([rnd.gauss(0, 1), float(i % 9)])) for i in range(26_000)]     # six days
    store = SignalStore(spark, scratch_path(spark, "t-sketch"))
    store.bulk_load(make_sig(rows))
    store.build_sketches()
    new = [(D0 + DAY_MS + i, 0, 50.0) for i in range(300)]
    store.append(make_sig(new))
    store.refresh_rollups(D0)
    for bucket in (DAY_MS, 6 * HOUR_MS, None):
        boxes = store.sketched_boxplot(D0, D0 + 7 * DAY_MS, bucket_ms=bucket)
        assert {f.split("/dt=")[0].rsplit("/", 1)[1] for f in boxes.inputFiles()} == {"l2q"}
        groups = {}
        for t, c, v in rows + new:
            groups.setdefault(c if bucket is None else t - t % bucket, []).append(v)
        found = {r["gk"]: r for r in boxes.collect()}
        assert found.keys() == groups.keys()
        for gk, r in found.items():
            values = sorted(groups[gk])
            assert (r["low"], r["high"], r["n"]) == (values[0], values[-1], len(values))
            for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                below, up_to = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < r[name], lambda v: v <= r[name]))
                assert below - 0.02 <= p <= up_to + 0.02
    with pytest.raises(ValueError):
        store.sketched_boxplot(D0, D0 + DAY_MS, bucket_ms=MINUTE_MS)


def test_rollup_stream_equals_batch_in_complete_mode(spark, make_sig):
    rows = [(D0 + i * 7_000, i % 2, float(i % 13)) for i in range(2000)]
    src = _stream_dir(spark, make_sig, rows)
    agg = rollup_stream(file_source(spark, src, make_sig([]).schema), "L1")
    name = "rollup_complete_test"
    q = agg.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = _rollup_rows(spark.table(name).drop("dt"))
    assert got == _rollup_rows(rollup(make_sig(rows), MINUTE_MS))


def test_iter_frames_bounded_and_ordered(spark, make_sig):
    from sigstrata.sources.delivery import iter_frames
    sig = make_sig([(i, 0, float(i)) for i in range(1000)]).orderBy("ts")
    frames = list(iter_frames(sig, frame_rows=300))
    assert [f.num_rows for f in frames] == [300, 300, 300, 100]
    assert [v for f in frames for v in f.column("ts").to_pylist()] == list(range(1000))


def test_drain_and_stop(spark, make_sig):
    from sigstrata.streaming.jobs import drain_and_stop
    rows = [(D0 + i, 0, 1.0) for i in range(50)]
    src = _stream_dir(spark, make_sig, rows)
    root = scratch_path(spark, "t-drain")
    q = start_ingest(file_source(spark, src, make_sig([]).schema), root, f"{root}/_ckpt")
    drain_and_stop(q)
    assert not q.isActive
    assert SignalStore(spark, root).unified().count() == 50


def test_append_after_archive_routes_late_rows_to_cold(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-late-append"))
    store.bulk_load(sig)
    store.archive_before(D0 + 3 * DAY_MS)
    extra = [(D0 + 5 * MINUTE_MS + 1, 0, 500.0), (D0 + DAY_MS + 1, 1, -3.0), (D0 + 4 * DAY_MS + 9, 1, 2.0)]
    repaired = store.append(make_sig(extra))
    assert [str(d) for d in repaired] == ["2022-01-08", "2022-01-09"]
    everything = make_sig(rows + extra)
    assert sorted_rows(store.unified().select("ts", "channel_id", "value")) == sorted(rows + extra)
    store.refresh_rollups(D0 + 4 * DAY_MS)                     # hot-side days refresh as usual
    assert _rollup_rows(store.rollup_layer("L1")) == _rollup_rows(rollup(everything, MINUTE_MS))


def test_fresh_layer_stitches_unrolled_tail(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-fresh"))
    cut = D0 + 3 * DAY_MS + 4 * HOUR_MS + 30 * MINUTE_MS
    store.bulk_load(sig.filter(F.col("ts") < cut))
    store.append(sig.filter(F.col("ts") >= cut))                # not refreshed yet
    # a late row inside the newest stored hour: the stored bucket is stale, the fresh read is not
    late = make_sig([(cut - 20 * MINUTE_MS, 1, 999.0)])
    store.append(late)
    sig = sig.unionByName(late)
    assert store.rollup_layer("L1").count() < rollup(sig, MINUTE_MS).count()
    for layer, w in (("L1", MINUTE_MS), ("L2", HOUR_MS)):
        assert _rollup_rows(store.fresh_layer(layer)) == _rollup_rows(rollup(sig, w))
    plan = store.fresh_layer("L1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_store_overview_matches_full_scan(spark, make_sig):
    from sigstrata.operators import overview
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-ov"))
    assert store.overview().first()["total_rows"] == 0
    store.write_channels(spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string"))
    store.bulk_load(sig)
    store.archive_before(D0 + 2 * DAY_MS)
    got, want = store.overview().first(), overview(store.unified(), store.channels()).first()
    assert got.asDict() == want.asDict() and got["total_rows"] == len(rows)


def test_register_views_for_sql(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-views"))
    store.write_channels(spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string"))
    store.bulk_load(sig)
    store.archive_before(D0 + 2 * DAY_MS)
    assert store.register_views("v_") == ["v_unified", "v_signals_l1", "v_signals_l2", "v_channels"]
    got = spark.sql("""SELECT c.name, count(*) AS n, sum(l.n) AS rolled FROM v_unified u
                       JOIN v_channels c ON u.channel_id = c.id
                       JOIN (SELECT channel_id, sum(n) AS n FROM v_signals_l2 GROUP BY 1) l
                         ON l.channel_id = u.channel_id GROUP BY c.name ORDER BY c.name""").collect()
    assert [(r["name"], r["n"]) for r in got] == [("a", len(rows) // 2), ("b", len(rows) // 2)]


def test_store_page_reads_only_needed_days_and_matches(spark, make_sig):
    from sigstrata.operators import next_cursor, signal_page
    # 6 days, heavy ts ties across channels, thin last day so a page spans several days
    rows = [(D0 + d * DAY_MS + (i // 3) * 60_000, i % 3, float((i * 7) % 5)) for d in range(6)
            for i in range(30 if d < 5 else 4)]
    sig = make_sig(rows)
    store = SignalStore(spark, scratch_path(spark, "t-page"))
    store.bulk_load(sig)
    store.archive_before(D0 + 2 * DAY_MS)
    u = store.unified()
    for ch in (None, 1):
        cursor, seen = None, []
        while True:
            got = store.page(25, channel_id=ch, cursor=cursor)
            want = signal_page(u, 25, channel_id=ch, cursor=cursor)
            g = [(r["ts"], r["channel_id"], r["value"]) for r in got.collect()]
            assert g == [(r["ts"], r["channel_id"], r["value"]) for r in want.collect()]
            seen += g
            if len(g) < 25:
                break
            cursor, _ = next_cursor(got)
        expect = [r for r in rows if ch is None or r[1] == ch]
        assert sorted(seen) == sorted(expect)
    read = store.page(10).select(F.count(F.lit(1)))        # two days and the newest hours of a third hold ten rows
    plan = store.page(10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "Subquery" in plan and read.first()[0] == 10


def test_relation_built_before_archive_still_reads(spark, make_sig):
    from sigstrata.plans.panels import signal_series
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-snapshot"))
    store.bulk_load(sig)
    u = store.unified()
    series = signal_series(store.layers(), None, D0, D0 + 5 * DAY_MS, pixel_width=100)
    before_rows, before_series = sorted_rows(u.select("ts", "channel_id", "value")), sorted_rows(series)
    store.archive_before(D0 + 2 * DAY_MS)
    assert sorted_rows(u.select("ts", "channel_id", "value")) == before_rows == sorted(rows)
    assert sorted_rows(series) == before_series
    store.archive_before(D0 + 3 * DAY_MS)                        # a relation built before one archive
    assert sorted_rows(store.unified().select("ts", "channel_id", "value")) == sorted(rows)


def test_archive_backfills_only_stale_rollup_days(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-r5"))
    store.bulk_load(sig, rollups=False)                          # no rollups yet: every day stale
    store.archive_before(D0 + 2 * DAY_MS)
    moved = sig.filter(F.col("ts") < D0 + 2 * DAY_MS)
    assert _rollup_rows(store.rollup_layer("L1")) == _rollup_rows(rollup(moved, MINUTE_MS))
    assert _rollup_rows(store.rollup_layer("L2")) == _rollup_rows(rollup(moved, HOUR_MS))


def _ingest_all(spark, stream, root, **options):
    q = start_ingest(stream, root, f"{root}/_ckpt", trigger={"availableNow": True}, **options)
    await_end(q)
    return SignalStore(spark, root)


def _all(store):
    return sorted_rows(store.unified().select("ts", "channel_id", "value"))


def test_null_and_non_finite_rows_are_rejected(spark):
    rows = [(D0, 0, 1.0), (None, 0, 1.0), (D0, None, 1.0), (D0, 0, None), (D0, 0, float("nan")), (D0, 0, float("-inf"))]
    store = SignalStore(spark, scratch_path(spark, "t-null"))
    store.append(spark.createDataFrame(rows, "ts long, channel_id int, value double"))
    assert _all(store) == [(D0, 0, 1.0)] and store.rejects().count() == 5
    assert store.append(store.unified()) == [] and store.rejects().count() == 5 and len(_all(store)) == 2


def test_keyed_append_can_be_retried(spark, make_sig):
    store = SignalStore(spark, scratch_path(spark, "t-key"))
    for _ in range(2):
        store.append(make_sig([(D0, 0, 1.0), (D0 + DAY_MS, 1, 2.0)]), key="load-1")
    store.append(make_sig([(D0, 0, 1.0)]), key="load-2")
    assert _all(store) == [(D0, 0, 1.0), (D0, 0, 1.0), (D0 + DAY_MS, 1, 2.0)]


def test_restarted_stream_goes_on_where_it_was(spark, make_sig):
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-restart")
    schema, rows = make_sig([]).schema, []
    for part in range(3):
        new = [(D0 + part * 1000 + i, i % 2, float(i)) for i in range(20)]
        make_sig(new).coalesce(1).write.parquet(f"{src}/{part}")
        rows += new
        store = _ingest_all(spark, file_source(spark, f"{src}/*", schema), root)
        assert _all(store) == sorted(rows)


def test_totals_outlast_the_progress_reports(spark, make_sig):
    from sigstrata.streaming.jobs import ingest_totals
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-totals")
    make_sig([(D0 + i, 0, 1.0) for i in range(60)]).repartition(6).write.parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        _ingest_all(spark, file_source(spark, src, make_sig([]).schema, max_files_per_trigger=1), root)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert tuple(ingest_totals(spark, root).first()) == (60, D0 + 59, 6)
    assert tuple(ingest_totals(spark, scratch_path(spark, "none")).first()) == (0, None, 0)


def test_rollups_follow_the_stream(spark, make_sig):
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-follow")
    rows = [(D0 + i * 50_000, i % 3, float(i % 7)) for i in range(3000)]
    make_sig(rows[1500:] + rows[:10]).coalesce(1).write.parquet(f"{src}/a")
    schema = make_sig([]).schema
    _ingest_all(spark, file_source(spark, f"{src}/*", schema), root, rollups=True)
    make_sig(rows[10:1500]).coalesce(1).write.parquet(f"{src}/b")       # days late
    store = _ingest_all(spark, file_source(spark, f"{src}/*", schema), root, rollups=True)
    for layer, width in (("L1", MINUTE_MS), ("L2", HOUR_MS)):
        assert _rollup_rows(store.rollup_layer(layer)) == _rollup_rows(rollup(make_sig(rows), width))


def test_overwrite_replaces_streamed_and_archived_rows(spark, make_sig):
    sig, rows = _five_days(make_sig)
    store = SignalStore(spark, scratch_path(spark, "t-over"))
    store.append(sig, key="a")
    assert store.bulk_load(sig) is False and len(_all(store)) == len(rows)
    store.archive_before(D0 + 2 * DAY_MS)
    assert store.bulk_load(store.unified().filter("channel_id = 0"), mode="overwrite") is True
    assert _all(store) == sorted(r for r in rows if r[1] == 0) and store.watermark() is None


def test_hot_ts_is_split_over_files(spark, make_sig):
    store = SignalStore(spark, scratch_path(spark, "t-hot"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the data is tiny here
    try:
        store.append(make_sig([(D0, c, float(v)) for c in range(4) for v in range(5000)]).repartition(8))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(store.hot().inputFiles()) > 1 and len(_all(store)) == 20_000


def test_rates_of_every_batch(spark, make_sig):
    from sigstrata.streaming.jobs import ingest_rates
    src, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-rates")
    make_sig([(D0 + i, 0, 1.0) for i in range(60)]).repartition(3).write.parquet(src)
    _ingest_all(spark, file_source(spark, src, make_sig([]).schema, max_files_per_trigger=1), root)
    rates = ingest_rates(spark, root).orderBy("batch_id").collect()
    assert len(rates) == 3 and rates[-1]["total"] == 60 == sum(r["rows"] for r in rates)
    assert rates[0]["seconds"] is None and all(r["rows_per_second"] > 0 for r in rates[1:])
