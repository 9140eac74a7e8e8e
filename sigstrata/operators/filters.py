"""Predicates on signal relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import nullable_int, time_range
from ..functions.time import date_of_ms, day_of


def range_condition(df: DataFrame, start, end, channel_id: int | None = None) -> Column:
    """Closed ``[start, end]`` on ``ts`` (K1), plus the derived ``dt`` predicate.

    The ``dt`` term is redundant for correctness but is what lets Spark prune day
    partitions of stored layers; the ``ts`` term is pushed into the Parquet scan. Bounds may
    be integers or scalar columns derived from data (e.g. ``quick_range``), in which case the
    ``dt`` term is evaluated at run time.
    """
    if isinstance(start, Column) or isinstance(end, Column):
        s = start if isinstance(start, Column) else F.lit(int(start))
        e = end if isinstance(end, Column) else F.lit(int(end))
        cond = F.col("ts").between(s, e)
        if "dt" in df.columns:
            cond = cond & F.col("dt").between(day_of(s), day_of(e))
    else:
        start, end = time_range(start, end)
        cond = F.col("ts").between(F.lit(start), F.lit(end))
        if "dt" in df.columns:
            cond = cond & F.col("dt").between(F.lit(date_of_ms(start)), F.lit(date_of_ms(end)))
    channel_id = nullable_int(channel_id, "channel_id")
    if channel_id is not None:
        cond = cond & (F.col("channel_id") == F.lit(channel_id))
    return cond


def in_range(df: DataFrame, start, end, channel_id: int | None = None) -> DataFrame:
    """Rows of ``df`` with ``start <= ts <= end`` and, when given, one channel."""
    return df.filter(range_condition(df, start, end, channel_id))


def before(df: DataFrame, watermark_ms: int) -> DataFrame:
    """``ts < watermark`` with the day-partition term."""
    cond = F.col("ts") < F.lit(int(watermark_ms))
    if "dt" in df.columns:
        cond = cond & (F.col("dt") <= F.lit(date_of_ms(int(watermark_ms))))
    return df.filter(cond)


def at_or_after(df: DataFrame, watermark_ms: int) -> DataFrame:
    cond = F.col("ts") >= F.lit(int(watermark_ms))
    if "dt" in df.columns:
        cond = cond & (F.col("dt") >= F.lit(date_of_ms(int(watermark_ms))))
    return df.filter(cond)


def after_cursor(cursor: tuple, compat: bool = False) -> Column:
    """Keyset predicate for the page order ``ts DESC, channel_id ASC, value ASC``.

    ``compat=True`` reproduces the plain ``ts < cursor`` form, which skips the rest of a
    tie on ``ts`` when a page ends inside it (K2).
    """
    if compat:
        c_ts = cursor[0] if isinstance(cursor, tuple) else cursor
        return F.col("ts") < F.lit(int(c_ts))
    c_ts, c_ch, c_v = cursor
    ts, ch, v = F.col("ts"), F.col("channel_id"), F.col("value")
    return (ts < F.lit(int(c_ts))) | (
        (ts == F.lit(int(c_ts))) & ((ch > F.lit(int(c_ch))) | ((ch == F.lit(int(c_ch))) & (v > F.lit(float(c_v))))))
