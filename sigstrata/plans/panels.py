"""Composite plans: adaptive series (V8) and the box panel (V9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import box_label
from ..operators.downsample import downsample, point_budget
from ..operators.index import top_k_per_group
from ..operators.reads import signal_range
from ..operators.stats import attach_outliers, boxplot, outliers
from .viewport import pick_bucket_ms, pick_layer


def signal_series(layers: dict[str, DataFrame], channel_id: int | None, start: int, end: int,
                  pixel_width: int = 800) -> DataFrame:
    """Chart series for a viewport (V8): layer by span (V1), range read (Q1), point budget
    (E4) and MinMax + LTTB (E3). ``layers`` maps ``L0/L1/L2`` to their relations.
    """
    layer = pick_layer(end - start)
    curve = signal_range(layers[layer], None, start, end, layer, ordered=False)
    if channel_id is not None:
        curve = curve.filter(curve.channel_id == int(channel_id))
    return downsample(curve, point_budget(pixel_width)).withColumnRenamed("seq", "point")


@dataclass
class BoxPanel:
    bucket_ms: int
    boxes: DataFrame
    points: DataFrame
    outliers: DataFrame     # number of outliers per channel before ``max_points`` cuts


def boxplot_panel(sig: DataFrame, channel_id: int | None, start: int, end: int,
                  quantile: str = "approx", max_points: int | None = None, tz: str = "UTC") -> BoxPanel:
    """Box panel (V9): width by span (V2), boxes (Q3) with labels (P10), outliers (Q5)
    attached to their boxes (J3). ``max_points`` cuts the points of each channel (``None``: all)."""
    w = pick_bucket_ms(end - start)
    boxes = boxplot(sig, start, end, channel_id, bucket_ms=w, quantile=quantile)
    boxes = boxes.withColumn("label", box_label("gk", tz))
    every = outliers(sig, channel_id, start, end, None, quantile=quantile)      # one set of fences for all that follows
    keys = ["channel_id"] if "channel_id" in every.columns else []
    pts = every if max_points is None else top_k_per_group(every, keys, ["ts", "value"], max_points)
    attached = attach_outliers(pts, boxes.select("gk", "label"), w)
    return BoxPanel(w, boxes, attached, every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_outliers")))
