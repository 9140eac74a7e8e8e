"""Session helpers: building a session, the shared checkpoint folder, lineage cuts.

Everything that must survive an executor loss (pinned range partitions, staged archive
files, streaming sinks in tests) lives under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent *and* the master is local
(tests, benchmarks) do we create a private folder under ``/tmp``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet sinks of the store use dynamic partition overwrite so a job rewrites only
    # the days it touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "sigstrata",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the defaults this library expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from the SparkContext or ``spark.checkpoint.dir``; a private ``/tmp`` folder is
    created only for local masters where nothing is configured.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="sigstrata-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes ``df`` to the shared folder and cuts its lineage.

    Used where two consumers must see *identical* partitions (range-partitioned index
    passes); a recomputation after an executor loss reads the written files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialize(df)`` and aggregates over its rows, from the one job that writes it."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
    return out, seen.get


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path objects for ``path`` (works for any cluster FS)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.exists(p))


def has_parquet(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds at least one Parquet data file (recursive)."""
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return False
    it = fs.listFiles(p, True)
    while it.hasNext():
        name = it.next().getPath().getName()
        if name.endswith(".parquet") and not name.startswith((".", "_")):
            return True
    return False


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


class query_tag:
    """Tag every Spark job started inside the block so another thread can cancel them.

    ``with query_tag(spark, "chart-3"): df.collect()`` in one thread,
    ``cancel(spark, "chart-3")`` in another (a newer viewport replacing an older query).
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag = spark, tag

    def __enter__(self):
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *exc):
        self.spark.removeTag(self.tag)
        return False


def cancel(spark: SparkSession, tag: str) -> None:
    """Interrupt all running jobs carrying ``tag`` (jobs fail with a cancellation error)."""
    spark.interruptTag(tag)
