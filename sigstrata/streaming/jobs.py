"""Structured Streaming jobs: ingest to the hot layer and rollup maintenance.

* T1 ``start_ingest``: every micro-batch is a keyed append (``SignalStore.append``): the key is
  the stream's id and the batch id, so a batch that is replayed after a failure is stored once, even if it was
  archived meanwhile (T3). Admission control is the source's rate option (``maxFilesPerTrigger`` /
  ``maxOffsetsPerTrigger``, T2); the micro-batch cadence is the trigger (default 500 ms).
  With ``rollups=True`` L1 and L2 follow, at most every ``refresh_every`` seconds (R6): the hours that batches since
  the last refresh had rows of, late or not, are recomputed, and no others (T5, T9).
* T4 every batch records its row count, newest ``ts`` and hours in one small file; ``ingest_totals`` (T6)
  sums them over all batches, however many, and ``ingest_rates`` shows rows per second. ``ingest_metrics`` shows the
  last progress reports.
* ``start_rollup``: the rollups as stream state, tumbling event-time windows with a watermark of the allowed
  lateness, upserted into the store in update mode; rows later than the
  watermark are counted (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.time import bucket_start, day_of, event_time
from ..schemas import HOUR_MS, MINUTE_MS
from ..session import hadoop_fs, path_exists
from ..sources.store import SignalStore

DEFAULT_TRIGGER = {"processingTime": "500 milliseconds"}
LATENESS = {"L1": "1 hour", "L2": "24 hours"}
WIDTH_MS = {"L1": MINUTE_MS, "L2": HOUR_MS}
METRICS_NAME = "ingest"
METRICS_SCHEMA = "stream string, batch_id bigint, count bigint, max_ts bigint, hours array<bigint>, at bigint"
# Fixed value: shortest time between two rollup refreshes of a stream.
REFRESH_SECONDS = 5.0


def file_source(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with an explicit schema and optional admission limit."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(path)


class _Ingest:
    """Writes the batches of one stream to a store."""

    def __init__(self, root: str, checkpoint: str, rollups: bool, refresh_every: float):
        self.root, self.checkpoint, self.rollups, self.refresh_every = root, checkpoint, rollups, refresh_every
        self.stream: str | None = None
        self.pending: set[int] = set()          # hours to refresh
        self.last, self.refreshed = -1, 0.0

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark, first = batch.sparkSession, self.stream is None
        store = SignalStore(spark, self.root)
        if first:
            self.stream = spark.read.json(f"{self.checkpoint}/metadata").first()["id"]
            self.pending |= self._unfinished(spark)
        batch = batch.persist()
        try:
            # only the first batch after a start can be a replay
            store.append(batch, f"{self.stream}-{batch_id}", retried=first)
            hours = batch.groupBy(bucket_start("ts", HOUR_MS).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).collect()
        finally:
            batch.unpersist()
        self.last = batch_id
        if hours:                               # one row per hour
            own = [r["hour"] for r in hours if r["hour"] is not None]
            row = {"stream": self.stream, "batch_id": batch_id, "count": sum(r["n"] for r in hours),
                   "max_ts": max((r["last"] for r in hours if r["last"] is not None), default=None), "hours": own, "at": int(time.time() * 1000)}
            _put(spark, f"{self.root}/_metrics/{self.stream}-{batch_id}.json", json.dumps(row))
            self.pending.update(own)
        if self.rollups and time.monotonic() - self.refreshed >= self.refresh_every:
            self.finish(spark)

    def finish(self, spark: SparkSession) -> None:
        """Bring the rollups up to the last batch."""
        if self.rollups and self.pending:
            SignalStore(spark, self.root).refresh_hours(sorted(self.pending))
            _put(spark, f"{self.root}/_rolled/{self.stream}", str(self.last))
            self.pending.clear()
        self.refreshed = time.monotonic()

    def _unfinished(self, spark: SparkSession) -> set[int]:
        """Hours of batches that an earlier run stored but did not roll up."""
        written = _metrics(spark, self.root).where(F.col("stream") == self.stream)
        if path_exists(spark, mark := f"{self.root}/_rolled/{self.stream}"):
            written = written.where(F.col("batch_id") > int(spark.read.text(mark).first()[0]))
        return {r["h"] for r in written.select(F.explode("hours").alias("h")).distinct().collect()}     # one row per hour


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file as a whole."""
    fs, target = hadoop_fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def start_ingest(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                 query_name: str | None = None, rollups: bool = False, refresh_every: float = REFRESH_SECONDS) -> StreamingQuery:
    """Append a ``(ts, channel_id, value)`` stream to the store at ``root`` (T1, T4); with ``rollups`` its L1 and L2 follow (T5).

    ``drain_and_stop``, ``await_end`` and ``finish_rollups`` bring the rollups up to the last batch.
    """
    observed = stream.select("ts", "channel_id", "value").observe(
        METRICS_NAME, F.count(F.lit(1)).alias("count"), F.max("ts").alias("max_ts"))
    ingest = _Ingest(root.rstrip("/"), checkpoint.rstrip("/"), rollups, refresh_every)
    writer = (observed.writeStream.foreachBatch(ingest.write).option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(**(trigger or DEFAULT_TRIGGER)))
    if query_name:
        writer = writer.queryName(query_name)
    query = writer.start()
    query.ingest = (ingest, stream.sparkSession)
    return query


def finish_rollups(query: StreamingQuery) -> None:
    """Refresh what the throttle has left, after the query has ended."""
    ingest, spark = query.ingest
    ingest.finish(spark)


def await_end(query: StreamingQuery) -> None:
    """Wait for a query that ends by itself, and finish its rollups."""
    query.awaitTermination()
    finish_rollups(query)


def _metrics(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/_metrics"
    return spark.read.schema(METRICS_SCHEMA).json(path) if path_exists(spark, path) else spark.createDataFrame([], METRICS_SCHEMA)


def ingest_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row ``rows_ingested, max_ts, batches`` over every batch ever written to the store."""
    return _metrics(spark, root).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("rows_ingested"),
                                     F.max("max_ts").alias("max_ts"), F.count(F.lit(1)).alias("batches"))


def ingest_rates(spark: SparkSession, root: str) -> DataFrame:
    """Per batch of each stream: ``rows``, ``total`` up to it, and ``seconds`` and ``rows_per_second`` since the batch before."""
    order = Window.partitionBy("stream").orderBy("batch_id")
    seconds = (F.col("at") - F.lag("at").over(order)) / 1000
    return _metrics(spark, root).select("stream", "batch_id", F.col("count").alias("rows"), F.sum("count").over(order).alias("total"),
                                        seconds.alias("seconds"), F.try_divide(F.col("count"), seconds).alias("rows_per_second"))


def rollup_stream(stream: DataFrame, layer: str, lateness: str | None = None) -> DataFrame:
    """Windowed rollup of a signal stream (T5): ``ts, channel_id, avg_v, min_v, max_v, n, dt``."""
    width = WIDTH_MS[layer]
    late = lateness or LATENESS[layer]
    agg = (stream.withColumn("et", event_time("ts")).withWatermark("et", late)
           .groupBy(F.window("et", f"{width // 1000} seconds"), "channel_id")
           .agg(F.avg("value").alias("avg_v"), F.min("value").alias("min_v"),
                F.max("value").alias("max_v"), F.count(F.lit(1)).alias("n")))
    ts = F.unix_millis(F.col("window.start"))
    return agg.select(ts.alias("ts"), "channel_id", "avg_v", "min_v", "max_v", "n", day_of(ts).alias("dt"))


def start_rollup(stream: DataFrame, root: str, checkpoint: str, lateness: str | None = None,
                 trigger: dict | None = None) -> StreamingQuery:
    """Keep L1 and L2 of the store at ``root`` by state (T5): the minutes that may still change are the stream's state, and each
    batch puts those it changed, open ones too, in the place of the stored ones; L2 follows from L1. L0 is not
    read. Rows later than ``lateness`` are dropped from the rollups (T9); a repeated batch changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        SignalStore(batch.sparkSession, root).merge_buckets(batch)

    return (rollup_stream(stream, "L1", lateness).drop("dt").writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{REFRESH_SECONDS:.0f} seconds"})).start())


def ingest_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Progress of a query as rows (T4, T6, T9): one row per reported micro-batch."""
    rows = []
    for prog in query.recentProgress:
        p = json.loads(prog.json) if hasattr(prog, "json") else dict(prog)
        obs = (p.get("observedMetrics") or {}).get(METRICS_NAME) or {}
        dropped = sum(int(s.get("numRowsDroppedByWatermark", 0) or 0) for s in p.get("stateOperators") or [])
        rows.append((int(p["batchId"]), int(p.get("numInputRows") or 0),
                     float(p.get("inputRowsPerSecond") or 0.0), float(p.get("processedRowsPerSecond") or 0.0),
                     None if obs.get("count") is None else int(obs["count"]),
                     None if obs.get("max_ts") is None else int(obs["max_ts"]), dropped))
    schema = ("batch_id bigint, num_input_rows bigint, input_rows_per_second double, "
              "processed_rows_per_second double, observed_count bigint, observed_max_ts bigint, "
              "rows_dropped_by_watermark bigint")
    return spark.createDataFrame(rows, schema)


def drain_and_stop(query: StreamingQuery) -> None:
    """Process everything already available, then stop."""
    query.processAllAvailable()
    query.stop()
    if hasattr(query, "ingest"):
        finish_rollups(query)
