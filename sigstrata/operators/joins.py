"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_BROADCAST_ROWS = 1_000_000


def broadcast_row_limit(df: DataFrame) -> int:
    v = df.sparkSession.conf.get("sigstrata.broadcast.maxRows", None)
    return int(v) if v else DEFAULT_BROADCAST_ROWS


def bounded_broadcast(df: DataFrame, max_rows: int | None = None, pin: bool = True,
                      known_rows: int | None = None) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` provably has at most ``max_rows`` rows, else ``df``.

    With ``pin`` (default) the side is first written once with a reliable checkpoint, so the
    size check and the join read the same small result instead of each recomputing it -- the
    sides passed here are aggregates whose inputs can be the whole viewport. The check counts
    at most ``max_rows + 1`` rows; above the bound the join falls back to a shuffle join (and
    AQE may still switch it at run time). ``known_rows`` skips the check for a side the caller
    has already pinned and counted.
    """
    limit = broadcast_row_limit(df) if max_rows is None else max_rows
    if known_rows is not None:                 # the caller already counted a pinned side
        return F.broadcast(df) if known_rows <= limit else df
    if pin:
        df = materialize(df)
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def with_channel_names(df: DataFrame, channels: DataFrame, channel_col: str = "channel_id") -> DataFrame:
    """Resolve ``channel_id`` to the dictionary name (J4); unknown ids keep a NULL name."""
    dim = channels.select(F.col("id").alias(channel_col), F.col("name").alias("channel_name"))
    return df.join(bounded_broadcast(dim), channel_col, "left")
