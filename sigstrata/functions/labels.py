"""Display projections (P9, P10) with an explicit time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .time import ntz_from_ms


def _wall_clock(ts_col: str, tz: str) -> Column:
    utc = ntz_from_ms(ts_col)
    if tz.upper() == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def time_text(ts_col: str = "ts", tz: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` of epoch ms in zone ``tz``."""
    return F.date_format(_wall_clock(ts_col, tz), "yyyy-MM-dd HH:mm:ss.SSS")


def box_label(gk_col: str = "gk", tz: str = "UTC") -> Column:
    """``MM-dd HH:mm`` category label of a box start (P10)."""
    return F.date_format(_wall_clock(gk_col, tz), "MM-dd HH:mm")


def channel_label(channel_col: str = "channel_id") -> Column:
    return F.concat(F.lit("CH-"), F.col(channel_col).cast("string"))


def detail_rows(sig: DataFrame, tz: str = "UTC") -> DataFrame:
    """Detail-table projection of signal rows (P9): text time, label, 3-decimal value, key."""
    return sig.select(
        "ts", "channel_id", "value",
        time_text("ts", tz).alias("time_text"),
        channel_label().alias("channel_label"),
        F.format_string("%.3f", F.col("value")).alias("value_text"),
        F.concat_ws("-", F.col("ts").cast("string"), F.col("channel_id").cast("string")).alias("row_key"),
    )
