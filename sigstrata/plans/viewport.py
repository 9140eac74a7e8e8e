"""Viewport rules (V1-V7): which layer, which bucket width, which range to read.

These decide *what* the data job reads before a plan is built; bounds that depend on data
(newest ``ts``, selected boxes) are returned as one-row DataFrames / scalar columns so the
whole chain stays lazy and distributed.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import int_arg, num
from ..operators.filters import in_range
from ..schemas import DAY_MS

# Span thresholds of the layer rule and candidate box widths (ms).
L2_SPAN_MS = 14 * DAY_MS
L1_SPAN_MS = 2 * DAY_MS
BUCKET_CANDIDATES_MS = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 900_000, 1_800_000, 3_600_000,
                        21_600_000, 86_400_000)
BUCKET_FALLBACK_MS = 7 * DAY_MS
BOXES_PER_VIEW = 40
QUICK_SPANS_MS = {"5m": 300_000, "1h": 3_600_000, "1d": DAY_MS, "7d": 7 * DAY_MS}
MIN_ZOOM_MS = 1_000


def pick_layer(span_ms: int) -> str:
    """Layer for a span (V1): above 14 days L2, above 2 days L1, else L0 (strict)."""
    span_ms = num(span_ms, "span_ms")
    if span_ms > L2_SPAN_MS:
        return "L2"
    if span_ms > L1_SPAN_MS:
        return "L1"
    return "L0"


def pick_bucket_ms(span_ms: int) -> int:
    """Box width for a span (V2): first candidate >= span/40, else 7 days."""
    at = bisect_left(BUCKET_CANDIDATES_MS, num(span_ms, "span_ms") / BOXES_PER_VIEW)
    return (*BUCKET_CANDIDATES_MS, BUCKET_FALLBACK_MS)[at]


def bounds(sig: DataFrame) -> Column:
    """Scalar struct ``(min_ts, max_ts)`` of a relation (evaluated once by Spark)."""
    return sig.select(F.struct(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))).scalar()


def quick_range(sig: DataFrame, span: str | int | None) -> tuple[Column, Column]:
    """``[max_ts - span, max_ts]`` of a quick range, or the full range for ``None`` (V3)."""
    b = bounds(sig)
    if span is None:
        return b["min_ts"], b["max_ts"]
    span_ms = QUICK_SPANS_MS[span] if isinstance(span, str) else int_arg(span, "span")
    return b["max_ts"] - F.lit(span_ms), b["max_ts"]


def slide_to(max_ts: int, span_ms: int) -> tuple[int, int]:
    """Keep the span, end at the newest ``ts`` (V4)."""
    return int(max_ts) - int(span_ms), int(max_ts)


def zoom(start: int, end: int, pct_start: float, pct_end: float) -> tuple[int, int] | None:
    """Sub-range at percentages of the viewport, rounded; ``None`` below 1 s (V5)."""
    span = int(end) - int(start)
    s = _round_half_up(start + pct_start / 100.0 * span)
    e = _round_half_up(start + pct_end / 100.0 * span)
    return None if e - s < MIN_ZOOM_MS else (s, e)


def _round_half_up(x: float) -> int:
    import math
    return int(math.floor(x + 0.5))


def zoom_columns(start: Column, end: Column, pct_start: float, pct_end: float) -> tuple[Column, Column]:
    """Column form of :func:`zoom` for data-dependent bounds; NULL bounds below 1 s."""
    span = end - start
    s = F.floor(start + F.lit(pct_start / 100.0) * span + F.lit(0.5)).cast("bigint")
    e = F.floor(start + F.lit(pct_end / 100.0) * span + F.lit(0.5)).cast("bigint")
    wide = e - s >= F.lit(MIN_ZOOM_MS)
    return F.when(wide, s), F.when(wide, e)


def drill(gk: int, bucket_ms: int) -> tuple[int, int]:
    """Range of one box: ``[gk, gk + w]`` (V6); closed, so it includes the next bucket's first ms."""
    return int(gk), int(gk) + int(bucket_ms)


def drill_boxes(boxes: DataFrame, bucket_ms: int) -> DataFrame:
    """Range covering selected boxes: one row ``start, end`` = ``[min gk, max gk + w]`` (V7)."""
    return boxes.agg(F.min("gk").alias("start"), (F.max("gk") + F.lit(int(bucket_ms))).alias("end"))


def between_columns(sig: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed range filter with data-dependent (scalar subquery) bounds; prunes day partitions."""
    return in_range(sig, start, end)
