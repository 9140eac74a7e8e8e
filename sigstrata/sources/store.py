"""Day-partitioned signal store: hot and archived L0, L1/L2 rollups.

Layout under one root (any shared Hadoop file system that renames a folder in one step)::

    g=<n>/hot/batch=<key>/dt=YYYY-MM-DD/    L0 rows: one folder per append (S5, S10, T1)
    g=<n>/archive/a=<watermark>-<id>/dt=.../  archived L0 rows (S7), one folder per archive, with the list
                                            ``_moved`` of the (batch, dt) folders that it holds
    g=<n>/l1/dt=..., g=<n>/l2/dt=...        minute and hour rollups (R1-R5)
    g=<n>/l2q/dt=...                        hourly quantile sketches, where they are built (A1)
    channels/v=<n>/                         channel dictionary, newest committed version counts (S2)
    rejects/batch=<key>/                    rows with NULL or non-finite fields (S1), where there are any
    _staged/                                writes under way

Every commit is one rename of a folder that is complete: an append, an archive with its list, or a whole new
generation ``g=<n>`` when everything is replaced. So a crash anywhere leaves the old or the new view.

The unified relation (S3) is all archived rows and the hot rows whose (batch, dt) is in no archive's
list: an anti-join on partition columns, needed only for days before the watermark and only until the listed folders are
deleted, which the next archive does (one cycle late, so relations built before an archive stay readable). File
names never come to the driver. A batch that appears at any other time (a late row, an append during the archive) is in no list:
it is visible at once, and the next archive moves it. One process archives at a time.

Relations are snapshots, as for any Spark file source: after ``refresh_rollups`` or
``bulk_load`` rebuild them (``store.unified()``, ``store.layers()``); an archive alone does
not invalidate them.
"""

from __future__ import annotations

import datetime as _dt
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import bucket_start, date_of_ms, day_floor_ms, day_of
from ..functions.args import int_arg
from ..operators.filters import in_range
from ..operators.joins import bounded_broadcast
from ..operators.reads import rollup, rollup_from_rollup, signal_page
from ..schemas import (CHANNEL_SCHEMA, DAY_MS, HOUR_MS, MINUTE_MS, ROLLUP_SCHEMA, ROLLUP_STORED_SCHEMA, SIGNAL_SCHEMA,
                       SIGNAL_STORED_SCHEMA)
from ..session import delete_path, hadoop_fs, has_parquet, materialize, path_exists

HOT_SCHEMA = T.StructType([*SIGNAL_STORED_SCHEMA.fields, T.StructField("batch", T.StringType())])
MOVED_SCHEMA = "batch string, dt date"

SKETCH_SCHEMA = T.StructType([T.StructField("ts", T.LongType()), T.StructField("channel_id", T.IntegerType()), T.StructField("n", T.LongType()),
                              T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("sketch", T.BinaryType()),
                              T.StructField("dt", T.DateType())])
# Size of a quantile sketch: its rank error is about 3 / SKETCH_K.
SKETCH_K = 800

ROLLUP_LAYERS = {"L1": ("l1", MINUTE_MS), "L2": ("l2", HOUR_MS)}
# How far behind the newest stored bucket a fresh read recomputes.
LOOKBACK_MS = {"L1": HOUR_MS, "L2": DAY_MS}


@dataclass
class ArchiveResult:
    archived: bool
    rows: int
    watermark: int | None = None


def _time_ordered(df: DataFrame, *folders: str) -> DataFrame:
    """Range-partition on ``ts`` and sort inside partitions before a write into ``folders``.

    Each task covers a contiguous range, so a hot day is split over many tasks, and every file
    is ``ts``-sorted: Parquet min/max statistics then skip row groups for range reads. Channel
    and a hash of the row break ties, so one hot ``ts`` is split as well.
    """
    rest = [c for c in df.columns if c not in ("ts", "channel_id")]
    return df.repartitionByRange("ts", "channel_id", F.xxhash64(*rest)).sortWithinPartitions(*folders, "ts")


def _sketched(rows: DataFrame) -> DataFrame:
    """``SKETCH_SCHEMA`` without the day, of L0 rows."""
    return rows.groupBy(bucket_start("ts", HOUR_MS).alias("ts"), "channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"))


class _Layers(dict):
    """Mapping of layer name to relation that builds a layer on first access."""

    def __init__(self, store: "SignalStore", fresh: bool):
        super().__init__()
        self._store, self._fresh = store, fresh

    def __missing__(self, name: str) -> DataFrame:
        if name not in ("L0", "L1", "L2"):
            raise KeyError(name)
        self[name] = df = self._store.layer(name, self._fresh)
        return df


class SignalStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- paths and reads -----------------------------------------------------------------
    def generation(self) -> int:
        """Number of the generation that counts: the newest whole one."""
        return max((int(name[2:]) for name, _ in self._folders(self.root, "g=")), default=0)

    def path(self, sub: str) -> str:
        """Folder of the current generation."""
        return f"{self.root}/g={self.generation():06d}/{sub}"

    def _folders(self, path: str, prefix: str) -> list[tuple[str, str]]:
        """``(name, path)`` of the folders in ``path`` whose names start with ``prefix``, in order of their names."""
        fs, p = hadoop_fs(self.spark, path)
        if not fs.exists(p):
            return []
        return sorted((st.getPath().getName(), st.getPath().toString()) for st in fs.listStatus(p)
                      if st.isDirectory() and st.getPath().getName().startswith(prefix))

    def _staged(self, name: str) -> str:
        return f"{self.root}/_staged/{name}-{uuid.uuid4().hex}"

    def _rename(self, old: str, new: str) -> bool:
        """Move a whole folder in one step; false if ``new`` is already there."""
        fs, target = hadoop_fs(self.spark, new)
        if fs.exists(target):
            return False
        fs.mkdirs(target.getParent())
        return bool(fs.rename(hadoop_fs(self.spark, old)[1], target))

    def _read(self, sub: str, schema: T.StructType) -> DataFrame:
        path = self.path(sub)
        if not has_parquet(self.spark, path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", path).parquet(path)
        return df.select(*[f.name for f in schema.fields])

    def _archives(self) -> list[tuple[int, str]]:
        """Watermarks and folders of the archives, ascending."""
        return [(int(name[2:].split("-")[0]), p) for name, p in self._folders(self.path("archive"), "a=")]

    def watermark(self) -> int | None:
        """Committed archive watermark (epoch ms of a UTC midnight), ``None`` before the first."""
        archives = self._archives()
        return archives[-1][0] if archives else None

    def _cleaned(self) -> int:
        """Watermark up to which the moved folders are deleted."""
        return max((int(name[2:]) for name, _ in self._folders(self.path("_cleaned"), "w=")), default=-1 << 62)

    def _moved(self, folders: list[str]) -> DataFrame:
        """The (batch, dt) folders that the archives in ``folders`` hold."""
        return self.spark.read.schema(MOVED_SCHEMA).parquet(*[f"{p}/_moved" for p in folders])

    def _visible_hot(self) -> DataFrame:
        hot, archives = self._read("hot", HOT_SCHEMA), self._archives()
        cleaned = self._cleaned()
        pending = [p for w, p in archives if w > cleaned]
        if not pending:
            return hot
        mark = F.lit(date_of_ms(archives[-1][0]))
        old = hot.where(F.col("dt") < mark).join(bounded_broadcast(self._moved(pending), pin=False), ["batch", "dt"], "left_anti")
        return hot.where(F.col("dt") >= mark).unionByName(old)

    def hot(self) -> DataFrame:
        """Hot L0 rows: batch-appended and stream-ingested (S4), archived ones left out."""
        return self._visible_hot().select(*SIGNAL_STORED_SCHEMA.fieldNames())

    def cold(self) -> DataFrame:
        return self._read("archive", SIGNAL_STORED_SCHEMA)

    def rollup_layer(self, layer: str) -> DataFrame:
        sub, _ = ROLLUP_LAYERS[layer]
        return self._read(sub, ROLLUP_STORED_SCHEMA)

    def _channel_versions(self) -> list[tuple[int, str]]:
        return [(int(name[2:]), p) for name, p in self._folders(f"{self.root}/channels", "v=")
                if path_exists(self.spark, f"{p}/_SUCCESS")]

    def channels(self) -> DataFrame:
        versions = self._channel_versions()
        if not versions:
            return self.spark.createDataFrame([], CHANNEL_SCHEMA)
        return self.spark.read.schema(CHANNEL_SCHEMA).parquet(versions[-1][1])

    def unified(self) -> DataFrame:
        """Hot and cold L0 as one relation."""
        hot, cold = self.hot(), self.path("archive")
        return hot.unionByName(self.cold()) if has_parquet(self.spark, cold) else hot

    def overview(self) -> DataFrame:
        """Overview (Q7) of the unified relation without scanning the whole ``ts`` column.

        Rows and days come from one scan that reads no column data; ``min(ts)``/``max(ts)`` only read the first and
        last day partitions.
        """
        u = self.unified()
        whole = u.select(F.struct(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))).scalar()
        lo = u.filter(F.col("dt") == whole["first"]).select(F.min("ts")).scalar()
        hi = u.filter(F.col("dt") == whole["last"]).select(F.max("ts")).scalar()
        chan = self.channels().select(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("name"))))).scalar()
        return self.spark.range(1).select(whole["n"].alias("total_rows"), lo.alias("min_ts"), hi.alias("max_ts"),
                                          F.coalesce(chan, F.array()).alias("channels"))

    def page(self, limit: int, channel_id: int | None = None, cursor=None, compat: bool = False) -> DataFrame:
        """Keyset page (Q2) that reads only the newest hours it needs.

        L2's row counts are a skip index: the newest hours before the cursor's that together hold ``limit`` rows hold the
        page, with the rest of the cursor's hour. Rows are only added, so counts of a stale rollup are too low at worst, and
        the hours chosen too many. Without rollups the whole relation is read.
        """
        limit = int_arg(limit, "limit", minimum=0)
        hours = self.rollup_layer("L2")
        if channel_id is not None:
            hours = hours.where(F.col("channel_id") == int(channel_id))
        if cursor is not None:
            at = int(cursor[0] if isinstance(cursor, tuple) else cursor)
            hours = hours.where(F.col("ts") < at - at % HOUR_MS)
        newer = Window.orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = hours.groupBy("ts").agg(F.sum("n").alias("n")).select("ts", F.sum("n").over(newer).alias("held"))
        cut = F.coalesce(counted.where(F.col("held") >= limit).select(F.max("ts")).scalar(), F.lit(_NO_TIME))
        unified = self.unified()
        rows = unified.where((F.col("ts") >= cut) & (F.col("dt") >= day_of(cut)))
        return signal_page(rows, limit, channel_id, cursor, compat)

    def _last_day(self, sub: str) -> _dt.date | None:
        """Newest ``dt=`` partition of a layer, from the directory listing (metadata only)."""
        days = self._folders(self.path(sub), "dt=")
        return _dt.date.fromisoformat(days[-1][0][3:]) if days else None

    def fresh_layer(self, layer: str) -> DataFrame:
        """A rollup layer that is never stale (§7.5 item 8): stored buckets older than the
        look-back, plus every newer bucket recomputed on the fly from the L0 tail.

        The look-back (1 h for L1, 24 h for L2) covers a newest bucket that was stored while
        half-filled and rows that arrived late within the allowed lateness. The tail is
        bounded by look-back plus refresh lag, and the cut-off is read from the newest ``dt``
        partition only, so nothing scans the whole layer.
        """
        sub, width = ROLLUP_LAYERS[layer]
        stored = self.rollup_layer(layer)
        last = self._last_day(sub)
        if last is None:
            return rollup(self.unified(), width).withColumn("dt", day_of("ts"))
        lookback = LOOKBACK_MS[layer]
        newest = stored.filter(F.col("dt") == F.lit(last)).select(F.max("ts")).scalar()
        cut = newest - F.lit(lookback)
        cut = cut - F.pmod(cut, F.lit(width).cast("bigint"))
        first_day = last - _dt.timedelta(days=1 + lookback // DAY_MS)
        old = stored.filter(F.col("ts") < cut)
        tail = self.unified().filter((F.col("dt") >= F.lit(first_day)) & (F.col("ts") >= cut))
        return old.unionByName(rollup(tail, width).withColumn("dt", day_of("ts")))

    def layer(self, name: str, fresh: bool = True) -> DataFrame:
        if name == "L0":
            return self.unified()
        return self.fresh_layer(name) if fresh else self.rollup_layer(name)

    def layers(self, fresh: bool = True) -> "_Layers":
        """``L0``/``L1``/``L2`` relations, each built only when first looked up."""
        return _Layers(self, fresh)

    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views ``unified``, ``signals_l1``, ``signals_l2`` (fresh) and ``channels`` so the
        layers can be queried with Spark SQL under the reference's relation names."""
        views = {"unified": self.unified(), "signals_l1": self.fresh_layer("L1"),
                 "signals_l2": self.fresh_layer("L2"), "channels": self.channels()}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]

    # ---- writes ---------------------------------------------------------------------------
    def write_channels(self, channels: DataFrame) -> None:
        """Replace the dictionary; ``channels`` may be built from the stored one.

        A new version is written beside the old one and counts once it is complete.
        """
        versions = self._channel_versions()
        n = versions[-1][0] + 1 if versions else 0
        channels.select("id", "name").write.mode("overwrite").parquet(f"{self.root}/channels/v={n:06d}")
        for _, old in versions[:-1]:
            delete_path(self.spark, old)

    def upsert_channels(self, names: DataFrame, name_col: str = "name") -> None:
        """Insert-or-ignore of channel names that persists."""
        from .adapters import ensure_channels
        self.write_channels(ensure_channels(self.channels(), names, name_col))

    def holds(self, key: str) -> bool:
        """Whether an append with ``key`` is stored, hot or archived."""
        if path_exists(self.spark, self.path(f"hot/batch={key}")):
            return True
        archives = [p for _, p in self._archives()]
        return bool(archives) and self._moved(archives).where(F.col("batch") == key).limit(1).count() > 0

    def append(self, sig: DataFrame, key: str | None = None, retried: bool = True) -> list[_dt.date]:
        """Append signal rows (S5) in one write job.

        An append with a ``key`` is stored once: repeated, it does nothing, even if its rows were archived meanwhile
        (``retried=False``: the caller knows that it is the first). Rows with
        a NULL or non-finite field go to ``rejects`` (S1). Rows older than the archive watermark
        are visible at once, and the rollups of their hours are brought up to date; their days are returned.
        """
        if key is not None and retried and self.holds(key):
            return []
        rows = sig.select(*[F.col(f.name).cast(f.dataType) for f in SIGNAL_SCHEMA.fields])
        good = (F.col("ts").isNotNull() & F.col("channel_id").isNotNull()
                & F.coalesce(F.abs("value") < F.lit(math.inf), F.lit(False)))
        batch, staged = key or uuid.uuid4().hex, self._staged("append")
        named = rows.withColumns({"kind": F.when(good, "good").otherwise("bad"), "dt": F.when(good, day_of("ts"))})
        _time_ordered(named, "kind", "dt").write.partitionBy("kind", "dt").parquet(staged)
        if path_exists(self.spark, f"{staged}/kind=bad"):
            self._rename(f"{staged}/kind=bad", f"{self.root}/rejects/batch={batch}")
        days = [_dt.date.fromisoformat(name[3:]) for name, _ in self._folders(f"{staged}/kind=good", "dt=")]
        if days:
            self._rename(f"{staged}/kind=good", self.path(f"hot/batch={batch}"))
        delete_path(self.spark, staged)
        w = self.watermark()
        late = [d for d in days if w is not None and d < date_of_ms(w)]
        self._refresh_stale(late)
        return late

    def rejects(self) -> DataFrame:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in SIGNAL_SCHEMA.fields])
        path = f"{self.root}/rejects"
        if not has_parquet(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def bulk_load(self, sig: DataFrame, mode: str = "skip_if_nonempty", rollups: bool = True) -> bool:
        """Idempotent history load (S10): skip when any row exists, or replace everything.

        A replacement is a new generation: rows and rollups are written whole, then one rename makes it count. The old
        generation stays for relations that read it, until the next replacement.
        """
        if mode not in ("skip_if_nonempty", "overwrite"):
            raise ValueError(f"unknown bulk_load mode {mode!r}")
        filled = any(has_parquet(self.spark, self.path(sub)) for sub in ("hot", "archive"))
        if mode == "skip_if_nonempty" and filled:
            return False
        if not filled:
            self.append(sig)
            if rollups:
                self.rebuild_rollups()
            return True
        now = self.generation()
        fresh = SignalStore(self.spark, self._staged("load"))
        fresh.append(sig)
        if rollups:
            fresh.rebuild_rollups()
        if has_parquet(self.spark, self.path("l2q")):
            fresh.build_sketches()
        if path_exists(self.spark, f"{fresh.root}/rejects"):
            for name, p in fresh._folders(f"{fresh.root}/rejects", "batch="):
                self._rename(p, f"{self.root}/rejects/{name}")
        hadoop_fs(self.spark, fresh.path("hot"))[0].mkdirs(hadoop_fs(self.spark, fresh.path("hot"))[1])     # a load without rows counts too
        for name, p in self._folders(self.root, "g="):
            if int(name[2:]) < now:
                delete_path(self.spark, p)
        self._rename(fresh.path("")[:-1], f"{self.root}/g={now + 1:06d}")
        delete_path(self.spark, fresh.root)
        return True

    # ---- rollups --------------------------------------------------------------------------
    def _write_rollup(self, layer: str, rows: DataFrame) -> None:
        sub = {**{k: v[0] for k, v in ROLLUP_LAYERS.items()}, "sketches": "l2q"}[layer]
        out = _time_ordered(rows.withColumn("dt", day_of("ts")), "dt")
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dt").parquet(self.path(sub)))

    def rebuild_rollups(self) -> None:
        """Compute L1 and L2 of the whole store: L1 from the unified L0; L2 from the L1 just written (about 60x less
        input, count-weighted means), so L0 is read once (R1, R2)."""
        self._write_rollup("L1", rollup(self.unified(), MINUTE_MS))
        self._write_rollup("L2", rollup_from_rollup(self.rollup_layer("L1"), HOUR_MS))

    def sketches(self) -> DataFrame:
        """Hourly quantile sketches: ``ts, channel_id, n, low, high, sketch, dt``."""
        return self._read("l2q", SKETCH_SCHEMA)

    def build_sketches(self) -> None:
        """Sketch the values of every hour and channel (A1); from then on, refreshed hours are sketched with the rollups."""
        self._write_rollup("sketches", _sketched(self.unified()))

    def sketched_boxplot(self, start: int, end: int, channel_id: int | None = None, bucket_ms: int | None = None) -> DataFrame:
        """Box statistics ``gk, low, q1, median, q3, high, n`` (Q3, Q4) of the hours that start in ``[start, end]``, from their
        sketches alone: no L0 row is read. ``low``, ``high`` and ``n`` are exact, the quartiles observed values of about
        their rank (``SKETCH_K``). ``bucket_ms`` must be whole hours."""
        if bucket_ms is not None and int_arg(bucket_ms, "bucket_ms", minimum=1) % HOUR_MS:
            raise ValueError("bucket_ms must be whole hours")
        key = F.col("channel_id").cast("bigint") if bucket_ms is None else bucket_start("ts", bucket_ms)
        merged = in_range(self.sketches(), start, end, channel_id).groupBy(key.alias("gk")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("all"))
        quartile = {name: F.kll_sketch_get_quantile_double("all", F.lit(p)).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
        return merged.select("gk", "low", *quartile.values(), "high", "n").orderBy("gk")

    def merge_buckets(self, buckets: DataFrame) -> None:
        """Put whole L1 buckets (``ROLLUP_SCHEMA``) in the place of stored ones, and derive their hours of L2 from L1: what a
        rollup that is kept as stream state has changed (T5). Repeating it changes nothing."""
        buckets = materialize(buckets.select(*ROLLUP_SCHEMA.fieldNames()))
        days = [r["d"] for r in buckets.select(day_of("ts").alias("d")).distinct().collect()]      # one row per day
        if not days:
            return
        in_days, hour = F.col("dt").isin(days), bucket_start("ts", HOUR_MS)
        others = self.rollup_layer("L1").where(in_days).drop("dt").join(buckets.select("ts", "channel_id"), ["ts", "channel_id"], "left_anti")
        l1 = materialize(others.unionByName(buckets))
        self._write_rollup("L1", l1)
        hours = buckets.select(hour.alias("_hour")).distinct()
        touched = l1.withColumn("_hour", hour).join(hours, "_hour", "left_semi")
        kept = self.rollup_layer("L2").where(in_days).drop("dt").withColumn("_hour", F.col("ts")).join(hours, "_hour", "left_anti").drop("_hour")
        self._write_rollup("L2", materialize(kept.unionByName(rollup_from_rollup(touched, HOUR_MS))))

    def refresh_hours(self, hours: list[int]) -> None:
        """Recompute the L1 and L2 buckets of ``hours`` (their starts) from their L0 rows alone.

        Both layers' buckets lie inside one hour. The other stored buckets of the same days are
        carried over: a day of L1 has 1,440 buckets per channel, whatever its number of rows.
        """
        if not hours:
            return
        days = sorted({date_of_ms(h) for h in hours})
        named = self.spark.createDataFrame([(int(h),) for h in sorted(hours)], "_hour bigint")
        hour = bucket_start("ts", HOUR_MS)
        in_days = F.col("dt").isin(days)
        rows = self.unified().where(in_days & F.col("ts").between(min(hours), max(hours) + HOUR_MS - 1))
        touched = rows.withColumn("_hour", hour).join(F.broadcast(named), "_hour", "left_semi")     # one row per hour
        new = materialize(rollup(touched, MINUTE_MS))
        for layer, fresh in (("L1", new), ("L2", rollup_from_rollup(new, HOUR_MS))):
            stored = self.rollup_layer(layer).where(in_days).withColumn("_hour", hour)
            others = stored.join(F.broadcast(named), "_hour", "left_anti").drop("_hour", "dt")
            self._write_rollup(layer, materialize(others.unionByName(fresh)))
        if has_parquet(self.spark, self.path("l2q")):
            others = self.sketches().where(in_days).join(F.broadcast(named), F.col("ts") == F.col("_hour"), "left_anti").drop("dt")
            self._write_rollup("sketches", materialize(others.unionByName(_sketched(touched))))

    def _stale_hours(self, days: Column | None = None) -> list[int]:
        """Hours of ``days`` whose rollups do not count as many rows as L0 (append-only store: an hour's content
        only changes by gaining rows, so equal counts mean up to date)."""
        hour = bucket_start("ts", HOUR_MS).alias("hour")

        def totals(df, n, name):
            return (df if days is None else df.where(days)).groupBy(hour).agg(n.alias(name))

        found = totals(self.unified(), F.count(F.lit(1)), "l0")
        for layer in ("L1", "L2"):
            found = found.join(totals(self.rollup_layer(layer), F.sum("n"), layer), "hour", "left")
        stale = found.where(~(F.col("l0").eqNullSafe(F.col("L1")) & F.col("l0").eqNullSafe(F.col("L2"))))
        return sorted(r["hour"] for r in stale.select("hour").collect())        # one row per stale hour

    def _refresh_stale(self, days: list[_dt.date]) -> list[_dt.date]:
        if not days:
            return []
        hours = self._stale_hours(F.col("dt").isin(days))
        self.refresh_hours(hours)
        return sorted({date_of_ms(h) for h in hours})

    def refresh_rollups(self, since_ms: int) -> list[_dt.date]:
        """Incremental refresh (R3/R4) of the stale hours from the day of ``since_ms`` on; returns their days. A repeated
        refresh without new rows rewrites nothing."""
        hours = self._stale_hours(F.col("dt") >= F.lit(date_of_ms(since_ms)))
        self.refresh_hours(hours)
        return sorted({date_of_ms(h) for h in hours})

    # ---- archive ----------------------------------------------------------------------------
    def archive_before(self, watermark_ms: int) -> ArchiveResult:
        """Move whole UTC days older than ``watermark_ms`` from hot to cold.

        The watermark is aligned down to midnight (K14). Returns ``archived=False`` when
        there is nothing to move.
        """
        w = day_floor_ms(int(watermark_ms))
        old = self.watermark()
        if old is not None and w <= old:
            return ArchiveResult(False, 0, old)
        for _, p in self._folders(f"{self.root}/_staged", "archive-"):      # what a crashed archive left
            delete_path(self.spark, p)
        # one listing: what appears later is in neither the export nor its list
        moving = self._visible_hot().where(F.col("dt") < F.lit(date_of_ms(w)))
        moved = materialize(moving.groupBy("batch", "dt").agg(F.count(F.lit(1)).alias("rows")))
        per_day = moved.groupBy("dt").agg(F.sum("rows").alias("rows")).collect()       # Q8; one row per day
        rows = sum(r["rows"] for r in per_day)
        if rows == 0:
            return ArchiveResult(False, 0, old)
        staged = self._staged("archive")
        export = _time_ordered(moving.select("ts", "channel_id", "value", "dt"), "dt")
        export.write.partitionBy("dt").parquet(staged)                                  # S7, whole days
        moved.select("batch", "dt").write.parquet(f"{staged}/_moved")
        # Only stale hours of the moved days are rebuilt, so relations that already read the others keep working
        self._refresh_stale([r["dt"] for r in per_day])
        self._clean()                                                                   # S9, one cycle late
        self._commit(staged, w)
        return ArchiveResult(True, rows, w)

    def _commit(self, staged: str, w: int) -> None:
        """The commit point: the archive and its list appear in one step."""
        self._rename(staged, self.path(f"archive/a={w:013d}-{uuid.uuid4().hex[:12]}"))

    def _clean(self) -> None:
        """Delete the hot folders that committed archives hold."""
        cleaned = self._cleaned()
        pending = [(w, p) for w, p in self._archives() if w > cleaned]
        if not pending:
            return
        hot = self.path("hot")

        def drop(r) -> None:
            delete_path(self.spark, f"{hot}/batch={r['batch']}/dt={r['dt']}")
            if not self._folders(f"{hot}/batch={r['batch']}", "dt="):
                delete_path(self.spark, f"{hot}/batch={r['batch']}")

        with ThreadPoolExecutor(8) as pool:
            for _ in pool.map(drop, self._moved([p for _, p in pending]).distinct().toLocalIterator()):
                pass
        fs, mark = hadoop_fs(self.spark, self.path(f"_cleaned/w={pending[-1][0]:013d}"))
        fs.mkdirs(mark)
        for name, p in self._folders(self.path("_cleaned"), "w=")[:-1]:
            delete_path(self.spark, p)


# Before any row, in milliseconds and still a date.
_NO_TIME = -50_000_000_000_000
