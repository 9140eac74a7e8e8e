"""Shape-preserving downsampling: MinMax preselect (E1), LTTB (E2), dispatch (E3), budget.

E1 is an aggregate over time slices; only slices that a bucket edge cuts are ranked. E2 is inherently sequential
(each pick depends on the previous one), so it is a fold over the sorted points of one series, in the
JVM -- but only ever on at most ``8 * threshold`` points per series, because E3 sends
bigger series through E1 first. Series are processed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.args import int_arg
from ..session import materialize_measured
from .joins import bounded_broadcast
from .slices import CROWDED, SLICE_ROWS, place_in_range, rank_rows, with_slices

# Fixed values of the dispatch rule: preselect above 8x the threshold, into 4x buckets.
PRESELECT_FACTOR = 8
PRESELECT_BUCKETS_PER_POINT = 4
MIN_POINT_BUDGET = 200


def point_budget(pixel_width: int) -> int:
    """Points per chart: ``max(200, 2 * pixel_width)``."""
    return max(MIN_POINT_BUDGET, 2 * int(pixel_width))


def lttb_picks(points: str, threshold: int) -> Column:
    """Largest-Triangle-Three-Buckets (E2) on a column of ordered arrays of structs with ``ts`` and ``value``: the points kept.

    First and last points are kept; the inner points are cut into ``threshold - 2`` buckets of
    fractional width; in each, the point forming the largest triangle with the previous pick and
    the centre of the next bucket wins, earliest on ties. Arrays with ``threshold >= n`` or
    ``threshold < 3`` are kept whole. Times are taken from the first point on, so that
    their sums are exact.
    """
    inner = threshold - 2
    if inner < 1:
        return F.col(points)

    def edge(k: str) -> str:
        # bucket k is points[edge(k)] up to before points[edge(k + 1)]; the one after the last is the last point
        return f"least(cast(floor({k} * ((size({points}) - 2) / {inner}D)) AS int) + 1, size({points}))"

    def part(k: int) -> str:
        return f"slice({points}, {edge(f'(k + {k})')} + 1, {edge(f'(k + {k + 1})')} - {edge(f'(k + {k})')})"

    def x(p: str) -> str:
        return f"cast({p}.ts - {points}[0].ts AS double)"

    area = f"""abs(({x('p')} - {x('acc.last')}) * (b.y - acc.last.value) - (p.value - acc.last.value) * (b.x - {x('acc.last')}))"""
    return F.expr(f"""
        CASE WHEN size({points}) <= {threshold} THEN {points} ELSE aggregate(
            transform(transform(sequence(0, {inner - 1}), k -> named_struct('own', {part(0)}, 'next', {part(1)})),
                      b -> named_struct('own', b.own, 'x', aggregate(b.next, 0D, (a, p) -> a + {x('p')}) / size(b.next),
                                        'y', aggregate(b.next, 0D, (a, p) -> a + p.value) / size(b.next))),
            named_struct('last', {points}[0], 'kept', array({points}[0])),
            (acc, b) -> transform(
                array(b.own[-array_max(transform(b.own, (p, i) -> named_struct('area', {area}, 'back', -i))).back]),
                pick -> named_struct('last', pick, 'kept', concat(acc.kept, array(pick))))[0],
            acc -> concat(acc.kept, slice({points}, -1, 1))) END""")


def _lttb(points: DataFrame, threshold: int, series: Sequence[str]) -> DataFrame:
    """E2 per series of ``series..., seq, ts, value`` rows (``seq`` orders preselected points; raw points carry 0),
    at most ``8 * threshold`` a series."""
    listed = points.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "value"))).alias("_points"))
    kept = listed.select(*series, lttb_picks("_points", threshold).alias("_kept"))
    return (kept.select(*series, F.posexplode("_kept").alias("_at", "_p"))
            .select(*series, F.col("_at").cast("bigint").alias("seq"), "_p.ts", "_p.value"))


def _bucket(index: Column, buckets: int) -> Column:
    """Bucket of the 0-based ``index`` in a series of ``_n`` points: the b with floor(b*n/T) <= i < floor((b+1)*n/T)."""
    return F.call_function("div", (index + 1) * buckets - 1, F.col("_n"))


def _points() -> list[Column]:
    """The smallest and the largest point of a group, the earliest on ties."""
    return [F.min(F.struct("value", "ts")).alias("lo"), F.max(F.struct(F.col("value"), (-F.col("ts")).alias("back"))).alias("hi")]


def _preselect(sized: DataFrame, series: Sequence[str], buckets: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """E1 on rows with the size ``_n`` and time range ``_first``, ``_last`` of their series: per bucket the min and the max point.

    One aggregate gives the rows and the extreme points of time slices (at least four per bucket). Their prefix sums tell which
    slices lie whole in a bucket: these are done. Only the rows of slices that a bucket edge cuts are ranked.
    """
    parts = F.greatest(F.lit(4 * buckets), F.ceil(F.col("_n") / F.lit(slice_rows))).cast("bigint")
    rows = sized.withColumn("_path", F.array(place_in_range(F.col("ts"), F.col("_first"), F.col("_last"), parts)))
    keys = [*series, "_path"]
    before = Window.partitionBy(*series).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_rows"), *_points())
    slices = slices.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint")))
    first, last = _bucket(F.col("_offset"), buckets), _bucket(F.col("_offset") + F.col("_rows") - 1, buckets)
    crowd = F.col("_cut") & (F.col("_rows") > CROWDED * slice_rows)
    slices, seen = materialize_measured(slices.withColumns({"_b": first, "_cut": first != last}), crowded=F.count_if(crowd), cut=F.count_if("_cut"))
    whole = slices.where("not _cut").select(*series, "_b", "lo", "hi")
    # a cut slice holds an edge, so a series has fewer of them than buckets
    cut = slices.where("_cut").select(*keys, "_n", "_offset", crowd.alias("_crowded"))
    within = with_slices(rows.select(*series, "_path", "ts", "value"), cut, series, seen["cut"])
    place = Window.partitionBy(*keys).orderBy("ts", "value")
    ranked = within.where("not _crowded").withColumn("_at", (F.row_number().over(place) - 1).cast("bigint")).drop("_crowded")
    if seen["crowded"]:
        held = [*series, "_n", "_offset"]
        crowded = within.where("_crowded").select(*held, "ts", "value")
        crowded = rank_rows(crowded, [("ts", False), ("value", False)], held, "_at", slice_rows=slice_rows)
        ranked = ranked.select(*held, "ts", "value", "_at").unionByName(crowded)
    edges = (ranked.withColumn("_b", _bucket(F.col("_offset") + F.col("_at"), buckets)).groupBy(*series, "_b").agg(*_points()))
    agg = whole.unionByName(edges).groupBy(*series, "_b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = F.struct("lo.ts", "lo.value"), F.struct((-F.col("hi.back")).alias("ts"), F.col("hi.value").alias("value"))
    pair = F.when(lo <= hi, F.array(lo, hi)).otherwise(F.array(hi, lo))
    return (agg.select(*series, "_b", F.posexplode(pair).alias("_k", "_p"))
            .select(*series, (F.col("_b") * 2 + F.col("_k")).cast("bigint").alias("seq"),
                    F.col("_p.ts").alias("ts"), F.col("_p.value").alias("value")))


def _sized(sig: DataFrame, series: Sequence[str]) -> tuple[DataFrame, int]:
    """The rows with the size and time range of their series, and the largest size."""
    rows = sig.select(*series, "ts", "value")
    sizes = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    sizes, seen = materialize_measured(sizes, series=F.count(F.lit(1)), most=F.max("_n"))
    return rows.join(bounded_broadcast(sizes, known_rows=seen["series"]), list(series)), seen["most"] or 0


def _numbered(sized: DataFrame, series: Sequence[str]) -> DataFrame:
    """Rows of small series with their place as ``seq``."""
    order = Window.partitionBy(*series).orderBy(F.col("ts").asc(), F.col("value").asc())
    return sized.select(*series, (F.row_number().over(order) - 1).cast("bigint").alias("seq"), "ts", "value")


def minmax_preselect(sig: DataFrame, target_buckets: int, series: Sequence[str] = ("channel_id",),
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """MinMax preselect (E1) per series: ``series..., seq, ts, value``.

    Series with ``n <= 2 * target_buckets`` pass through; otherwise bucket ``b`` holds index
    ``floor(b*n/T) <= i < floor((b+1)*n/T)`` and emits its min and max point in index order
    (earliest index on ties; the same point twice when min and max coincide).
    """
    t = int_arg(target_buckets, "target_buckets", minimum=1)
    sized, most = _sized(sig, series)
    small = _numbered(sized.filter(F.col("_n") <= 2 * t), series)
    if most <= 2 * t:
        return small
    return small.unionByName(_preselect(sized.filter(F.col("_n") > 2 * t), series, t, slice_rows))


def downsample(sig: DataFrame, threshold: int, series: Sequence[str] = ("channel_id",)) -> DataFrame:
    """MinMax + LTTB dispatch (E3) per series: ``series..., seq, ts, value`` with ``seq`` the
    output position.

    ``n <= threshold``: input returned; ``n > 8*threshold``: E1 with ``4*threshold`` buckets
    then LTTB; otherwise LTTB directly. LTTB never sees more than ``8*threshold`` points.

    Series sizes and time ranges are measured first (one aggregate). Series of at most ``8*threshold`` points
    are only ordered by the LTTB stage itself, or numbered if they pass through.
    """
    t = int_arg(threshold, "threshold", minimum=1)
    series = list(series)
    sized, max_n = _sized(sig, series)
    n = F.col("_n")
    passthru = _numbered(sized.filter(n <= t), series)
    if max_n <= t:                                  # every series fits the budget: no LTTB stage
        return passthru
    lttb_in = sized.filter((n > t) & (n <= PRESELECT_FACTOR * t)).select(
        *series, F.lit(0).cast("bigint").alias("seq"), "ts", "value")
    if max_n > PRESELECT_FACTOR * t:
        big = _preselect(sized.filter(n > PRESELECT_FACTOR * t), series, PRESELECT_BUCKETS_PER_POINT * t)
        lttb_in = lttb_in.unionByName(big)
    return passthru.unionByName(_lttb(lttb_in, t, series))
