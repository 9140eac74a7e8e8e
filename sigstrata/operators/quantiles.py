"""Grouped quantile statistics (A1, A2) in two modes.

* ``approx`` -- ``percentile_approx`` with partial (map-side) sketch merge: one hash
  shuffle of small sketches, bounded memory per group whatever its size. This is the
  scale path and matches the reference, which also uses an approximate quantile.
* ``exact`` -- interpolated quantiles (same definition as ``percentile`` / ``quantile_cont``) in two scans, by
  selection: the sketch gives a bracket of values around each wanted rank; the second scan counts the rows between
  brackets, and counts the values inside them; the ranks are looked up among these. A bracket
  holds a share of about ``6 / accuracy`` of the rows (groups of under ``accuracy`` rows are one bracket).
  Nothing else is shuffled, sorted or kept, however large or repetitive a group is. If a sketch missed a rank (its error
  bound says it does not), that group is looked up between its smallest and largest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_measured
from .joins import bounded_broadcast
from .slices import place_in_range

DEFAULT_ACCURACY = 10_000
MODES = ("approx", "exact")
# Half width of a bracket in units of the sketch's rank error.
MARGIN = 3
# Values inside the brackets that one task may order; more are narrowed down by counts first.
BRACKET_VALUES = 1_000_000
CELLS = 1024


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], mode: str = "approx", accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """Per group of ``keys``: ``low`` (min), named quantiles, ``high`` (max) and ``n``.

    With empty ``keys`` the result has one row for the whole input (zero rows if empty). NULL values are
    counted but have no rank, NaN is larger than any number, and a NULL key is a group.
    """
    if mode not in MODES:
        raise ValueError(f"quantile mode must be one of {MODES}: {mode!r}")
    if len(probs) != len(names):
        raise ValueError("probs and names differ in length")
    keys = list(keys)
    if mode == "approx":
        agg = df.groupBy(*keys).agg(
            F.min(value).alias("low"),
            F.percentile_approx(value, list(probs), accuracy).alias("_q"),
            F.max(value).alias("high"),
            F.count(F.lit(1)).alias("n"))
        return agg.select(*keys, "low", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], "high", "n")
    return _exact(df, keys, value, probs, names, accuracy)


def _exact(df: DataFrame, keys: list[str], value: str, probs, names, accuracy: int) -> DataFrame:
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    rows = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    order = sorted(set(probs))
    near = [x for p in order for x in (max(0.0, p - MARGIN / accuracy), min(1.0, p + MARGIN / accuracy))]
    sketch = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("_n"), F.min("_v").alias("low"),
                                    F.max("_v").alias("high"), F.percentile_approx("_v", near, accuracy).alias("_q"))
    at = {p: F.col("_n").cast("double").__sub__(1) * F.lit(float(p)) for p in order}
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in at.values() for f in (F.floor, F.ceil)]))
    # a bracket per probability; a small group is one bracket
    small = F.col("_n") < accuracy
    begin = F.array(*[F.when(small, F.col("low")).otherwise(F.col("_q")[2 * i]) for i in range(len(order))])
    end = F.array(*[F.when(small, F.col("high")).otherwise(F.col("_q")[2 * i + 1]) for i in range(len(order))])
    sketch, seen = materialize_measured(sketch.select("*", ranks.alias("_ranks"), begin.alias("_begin"), end.alias("_end")),
                                        groups=F.count(F.lit(1)), most=F.max("n"))
    if (seen["most"] or 0) < accuracy:          # every group is one bracket: the built-in function orders as many values
        agg = df.groupBy(*keys).agg(F.min(value).alias("low"), F.percentile(value, list(probs)).alias("_q"),
                                    F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
        return agg.select(*keys, "low", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], "high", "n")

    def between(x):
        (a, b), (lower, upper) = (F.floor(x), F.ceil(x)), (F.element_at("_found", f(x).cast("bigint")) for f in (F.floor, F.ceil))
        return F.when(lower == upper, lower).otherwise((b - x) * lower + (x - a) * upper)

    def looked_up(rows, wanted):
        found = _select(rows, wanted.where("_n > 0"), seen["groups"]).select("_g", "_found")
        missed = (F.col("_n") > 0) & (F.coalesce(F.size("_found"), F.lit(-1)) < F.size("_ranks"))
        return wanted.join(found, "_g", "left").select(
            "_g", "low", *[between(at[p]).alias(f"_is_{nm}") for p, nm in zip(probs, names)], "high", "n", missed.alias("_missed"))

    out, got = materialize_measured(looked_up(rows, sketch), missed=F.count_if("_missed"))
    if got["missed"]:
        again = out.where("_missed").select("_g")
        whole = materialize(sketch.join(again, "_g", "left_semi").withColumns({"_begin": F.array("low"), "_end": F.array("high")}))
        out = out.where("not _missed").unionByName(looked_up(rows.join(again, "_g", "left_semi"), whole))
    own = [F.col(f"_g.{k}").alias(k) for k in keys]
    return out.select(*own, "low", *[F.col(f"_is_{nm}").alias(nm) for nm in names], "high", "n")


def _select(rows: DataFrame, wanted: DataFrame, groups: int) -> DataFrame:
    """``(_g, _ranks, _found)``: a map from wanted rank to value, from one scan of ``rows``."""
    side = bounded_broadcast(wanted.select("_g", "_begin", "_end"), known_rows=groups)
    v = F.col("_v")
    # brackets ascend, so rows fall between two (counted) or into some (counted by value)
    behind = F.aggregate("_end", F.lit(0), lambda a, e: a + (e < v).cast("int"))
    inside = F.exists(F.arrays_zip("_begin", "_end"), lambda b: (b["_begin"] <= v) & (v <= b["_end"]))
    dealt = rows.where(v.isNotNull()).join(side, "_g").select("_g", behind.alias("_gap"), inside.alias("_in"), F.when(inside, v).alias("_v"))
    counted, size = materialize_measured(dealt.groupBy("_g", "_gap", "_in", "_v").agg(F.count(F.lit(1)).alias("_c")), values=F.count(F.lit(1)))
    ranks = bounded_broadcast(wanted.select("_g", "_ranks"), known_rows=groups)
    if size["values"] <= BRACKET_VALUES:       # few enough to be ordered by group at once
        up_to = Window.partitionBy("_g").orderBy("_gap", "_in", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return _picked(counted.withColumn("_end", F.sum("_c").over(up_to)).where("_in").join(ranks, "_g"))
    parts = counted.groupBy("_g", "_gap", "_in").agg(F.sum("_c").alias("_sum"), F.count(F.lit(1)).alias("_size"),
                                                     F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy("_g").orderBy("_gap", "_in").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("bigint"))).where("_in")
    parts = parts.join(wanted.select("_g", "_ranks"), "_g").select(
        "_g", F.array("_gap").alias("_part"), "_before", "_sum", "_size", "_low", "_high", "_ranks")
    values = counted.where("_in").select("_g", F.array("_gap").alias("_part"), "_v", "_c")
    while True:
        parts = materialize(parts)      # a narrowed bracket is a part of its own
        large = parts.where(F.col("_size") > BRACKET_VALUES)
        if not large.limit(1).count():
            break
        # keep the cells of a large bracket that hold a wanted rank
        cell = place_in_range(F.col("_v"), F.col("_low"), F.col("_high"), F.lit(CELLS).cast("bigint"))
        celled = (values.join(large.select("_g", "_part", "_low", "_high"), ["_g", "_part"])
                  .select("_g", "_part", F.concat("_part", F.array(cell.cast("int"))).alias("_cell"), "_v", "_c"))
        cells = celled.groupBy("_g", "_part", "_cell").agg(F.sum("_c").alias("_sum"), F.count(F.lit(1)).alias("_size"),
                                                           F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        earlier = Window.partitionBy("_g", "_part").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_less", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("bigint")))
        cells = (cells.join(large.select("_g", "_part", "_before", "_ranks"), ["_g", "_part"])
                 .withColumn("_before", F.col("_before") + F.col("_less"))
                 .where(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sum")))))
        cells = materialize(cells.select("_g", F.col("_cell").alias("_part"), "_before", "_sum", "_size", "_low", "_high", "_ranks"))
        kept = celled.select("_g", F.col("_cell").alias("_part"), "_v", "_c").join(cells.select("_g", "_part"), ["_g", "_part"], "left_semi")
        values = materialize(values.join(large.select("_g", "_part"), ["_g", "_part"], "left_anti").unionByName(kept))
        parts = parts.where(F.col("_size") <= BRACKET_VALUES).unionByName(cells)
    up_to = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = values.join(parts.select("_g", "_part", "_before", "_ranks"), ["_g", "_part"])
    return _picked(ordered.withColumn("_end", F.col("_before") + F.sum("_c").over(up_to)))


def _picked(ordered: DataFrame) -> DataFrame:
    """The wanted ranks among values that end before the rank ``_end``."""
    hits = F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")))
    picked = ordered.select("_g", "_ranks", F.explode(hits).alias("r"), "_v")
    return picked.groupBy("_g", "_ranks").agg(F.map_from_entries(F.collect_list(F.struct("r", "_v"))).alias("_found"))
