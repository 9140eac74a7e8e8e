"""Adapters from the driver tables to the signal model, and the channel dictionary.

``events``   -> ``ts`` = ms of the event time, ``channel_id`` = dense id of ``event_type``
``lineitem`` -> ``ts`` = ms of the ship date, ``channel_id`` = dense id of ``l_returnflag``,
                ``value`` = ``l_extendedprice`` (whole-day ``ts``: heavy ties, multi-year span)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import ms_from_ntz
from ..schemas import CHANNEL_SCHEMA
from ..operators.index import with_row_index
from ..operators.joins import bounded_broadcast

# Dictionaries up to this many names are applied as a literal map lookup.
MAP_LOOKUP_MAX = 4096

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def channel_dictionary(names: DataFrame, name_col: str = "name") -> DataFrame:
    """``id, name`` with ids dense in name order (0-based).

    Distinct names are ranked with the distributed row index, so even a dictionary of
    millions of names is never sorted by a single task.
    """
    distinct = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    idx = with_row_index(distinct, [F.col("name").asc()], index_col="_i")
    return idx.select(F.col("_i").cast("int").alias("id"), "name")


def ensure_channels(channels: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Insert-or-ignore of channel names (S2, J5): unknown names get the next free ids."""
    new = (names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
           .join(channels.select("name"), "name", "left_anti"))
    base = channels.select(F.coalesce(F.max("id") + 1, F.lit(0)).alias("base")).scalar()
    added = with_row_index(new, [F.col("name").asc()], index_col="_i")
    return channels.select("id", "name").unionByName(added.select((base + F.col("_i")).cast("int").alias("id"),
                                                                  "name"))


def _small_dictionary(df: DataFrame, name_col: str) -> list[tuple[int, str]] | None:
    """Dense ids of the distinct names when there are at most ``MAP_LOOKUP_MAX`` of them.

    One aggregate job fetches at most ``MAP_LOOKUP_MAX + 1`` distinct names; ranking that
    many strings on the driver is trivial. ``None`` when the dictionary is bigger.
    """
    names = [r[0] for r in df.select(name_col).where(F.col(name_col).isNotNull()).distinct()
             .limit(MAP_LOOKUP_MAX + 1).collect()]
    if len(names) > MAP_LOOKUP_MAX:
        return None
    return list(enumerate(sorted(names)))


def to_signals(df: DataFrame, ts_col, name_col: str, value_col: str,
               channels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Map a table with a time, a category and a number to ``(signals, channels)``.

    A dictionary of at most ``MAP_LOOKUP_MAX`` names (checked by fetching at most one row
    more) becomes a literal map lookup inside the scan stage: no join, no extra shuffle.
    Bigger dictionaries are ranked and joined on the cluster (broadcast behind a row-count
    check).
    """
    ts = ms_from_ntz(ts_col) if isinstance(ts_col, str) else ts_col
    if channels is None:
        pairs = _small_dictionary(df, name_col)
    else:
        rows = channels.select("id", "name").limit(MAP_LOOKUP_MAX + 1).collect()
        pairs = [(r["id"], r["name"]) for r in rows] if len(rows) <= MAP_LOOKUP_MAX else None
    if pairs is not None:
        channels = df.sparkSession.createDataFrame(pairs, CHANNEL_SCHEMA)
        lookup = F.create_map(*[x for i, nm in pairs for x in (F.lit(nm), F.lit(i))]) if pairs else None
        cid = lookup[F.col(name_col)] if lookup is not None else F.lit(None).cast("int")
        sig = (df.select(ts.alias("ts"), cid.alias("channel_id"), F.col(value_col).cast("double").alias("value"))
               .filter(F.col("channel_id").isNotNull()))
        return sig, channels
    if channels is None:
        channels = channel_dictionary(df, name_col)
    dim = bounded_broadcast(channels.select(F.col("name").alias(name_col), F.col("id").alias("channel_id")))
    sig = (df.select(ts.alias("ts"), F.col(name_col), F.col(value_col).cast("double").alias("value"))
           .join(dim, name_col).select("ts", "channel_id", "value"))
    return sig, channels


def signals_from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return to_signals(events, "ts", "event_type", "value")


def signals_from_lineitem(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    return to_signals(lineitem, "l_shipdate", "l_returnflag", "l_extendedprice")


def event_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return signals_from_events(read_table(spark, sf_dir, "events"))


def lineitem_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return signals_from_lineitem(read_table(spark, sf_dir, "lineitem"))
