"""Box plots, IQR outliers and histograms.

One-row statistics (fences, histogram bounds) are attached to the scanned rows as scalar
subqueries: Spark evaluates them once and inlines the values, so there is no join at all
and the fence even reaches the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.args import int_arg, nullable_int
from ..functions.time import bucket_start
from .filters import in_range
from .index import top_k_per_group
from .joins import bounded_broadcast
from .quantiles import DEFAULT_ACCURACY, group_quantiles

IQR_K = 1.5


def boxplot(sig: DataFrame, start: int, end: int, channel_id: int | None = None,
            bucket_ms: int | None = None, quantile: str = "approx",
            accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Box statistics ``gk, low, q1, median, q3, high, n`` ordered by ``gk``.

    ``bucket_ms`` given: one box per time bucket, ``gk`` = bucket start (Q3). Otherwise one
    box per channel, ``gk`` = channel id (Q4). Whiskers are the true min / max (K6).
    """
    bucket_ms = nullable_int(bucket_ms, "bucket_ms", minimum=1)
    base = in_range(sig, start, end, channel_id)
    if bucket_ms is not None:
        keyed = base.select(bucket_start("ts", bucket_ms).alias("gk"), "value")
    else:
        keyed = base.select(F.col("channel_id").cast("bigint").alias("gk"), "value")
    box = group_quantiles(keyed, ["gk"], "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                          mode=quantile, accuracy=accuracy)
    return box.orderBy("gk")


def _fence_columns(q: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", (F.col("q1") - F.lit(IQR_K) * iqr).alias("fence_lo"),
                    (F.col("q3") + F.lit(IQR_K) * iqr).alias("fence_hi"))


def outliers(sig: DataFrame, channel_id: int | None, start: int, end: int, max_points: int | None,
             quantile: str = "approx", accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Rows strictly outside the 1.5 IQR fences (Q5, K7, K8): all (``max_points=None``), or the
    earliest ``max_points``, ties by value.

    The fences are computed over the whole viewport of the channel. With
    ``channel_id=None`` every channel is handled separately (fences and limit per channel)
    and the result carries ``channel_id``.
    """
    max_points = nullable_int(max_points, "max_points", minimum=0)
    base = in_range(sig, start, end, channel_id)
    if channel_id is not None:
        q = _fence_columns(group_quantiles(base, [], "value", [0.25, 0.75], ["q1", "q3"], mode=quantile,
                                           accuracy=accuracy))
        fences = q.select(F.struct("fence_lo", "fence_hi")).scalar()
        hits = base.filter((F.col("value") < fences["fence_lo"]) | (F.col("value") > fences["fence_hi"]))
        hits = hits.select("ts", "value").orderBy("ts", "value")
        return hits if max_points is None else hits.limit(max_points)
    q = _fence_columns(group_quantiles(base, ["channel_id"], "value", [0.25, 0.75], ["q1", "q3"], mode=quantile,
                                       accuracy=accuracy))
    fences = bounded_broadcast(q.select("channel_id", "fence_lo", "fence_hi"))
    hits = (base.select("channel_id", "ts", "value").join(fences, "channel_id")
            .filter((F.col("value") < F.col("fence_lo")) | (F.col("value") > F.col("fence_hi")))
            .select("channel_id", "ts", "value"))
    if max_points is None:
        return hits
    return top_k_per_group(hits, ["channel_id"], ["ts", "value"], max_points)


def attach_outliers(points: DataFrame, boxes: DataFrame, bucket_ms: int) -> DataFrame:
    """Outlier points joined to the box of their bucket; points without a box drop."""
    bucket_ms = int_arg(bucket_ms, "bucket_ms", minimum=1)
    keyed = points.withColumn("gk", bucket_start("ts", bucket_ms))
    box_cols = [c for c in boxes.columns if c not in keyed.columns or c == "gk"]
    # one box per bucket: the side whose size is checked
    return keyed.join(bounded_broadcast(boxes.select(*box_cols)), "gk", "inner")


def _bin_expr(bins: int):
    width = F.nullif((F.col("hi") - F.col("lo")) / F.lit(bins), F.lit(0.0))
    return F.least(F.floor((F.col("value") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))


def histogram(sig: DataFrame, channel_id: int | None, start: int, end: int, bins: int,
              edges: bool = False, dense: bool = False) -> DataFrame:
    """Equal-width histogram ``bin, n, lo, hi`` between the viewport min and max (Q6).

    A constant series puts every row into the last bin (K9); empty bins are absent unless
    ``dense`` (K10). ``edges`` adds ``bin_start``/``bin_end`` (Q6b). ``channel_id=None``
    gives one histogram per channel with a ``channel_id`` column.
    """
    bins = int_arg(bins, "bins", minimum=1)
    base = in_range(sig, start, end, channel_id)
    keys = [] if channel_id is not None else ["channel_id"]
    if channel_id is not None:
        b = base.select(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi"))).scalar()
        rows = base.select("value", b["lo"].alias("lo"), b["hi"].alias("hi"))
        bounds = None
    else:
        bounds = bounded_broadcast(base.groupBy("channel_id").agg(F.min("value").alias("lo"),
                                                                  F.max("value").alias("hi")))
        rows = base.select("channel_id", "value").join(bounds, "channel_id")
    hist = rows.groupBy(*keys, _bin_expr(bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    if dense:
        if bounds is None:
            bounds = base.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter(F.col("lo").isNotNull())
        grid = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
        hist = (grid.join(hist.select(*keys, "bin", "n"), [*keys, "bin"], "left")
                .select(*keys, "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "lo", "hi"))
    if edges:
        step = (F.col("hi") - F.col("lo")) / F.lit(bins)
        hist = hist.withColumn("bin_start", F.col("lo") + F.col("bin") * step) \
                   .withColumn("bin_end", F.col("lo") + (F.col("bin") + 1) * step)
    return hist.orderBy(*keys, "bin")
