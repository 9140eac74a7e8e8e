"""Ranks from slice counts: a prefix-sum index over the numbers of rows in slices of the key range.

A row's rank in an order is the number of rows in the slices before its own, plus its place in that slice. So one
aggregate (rows per slice) replaces a global sort: slices are ranges of the first order key, cut so that a slice
holds about ``slice_rows`` rows where keys are spread evenly, and only rows inside one slice are ever compared.

* A slice that holds far more rows (ties, gaps elsewhere) is cut again, by the first order key that is not
  constant in it, until it is small enough or all its rows are equal in every order key.
* Rows that are equal in every key are folded into one with a count, and numbered when they are unfolded.
* Nothing is checkpointed but the slice table: its size is the number of rows by ``slice_rows``.

Rows are read once for the key range, once for the counts, and once for the result (plus once for crowded slices only,
per cut). Sorting is done inside slices, by a window after one hash shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_measured
from .joins import bounded_broadcast

SLICE_ROWS = 250_000
CROWDED = 4                 # times ``slice_rows`` from which a slice is cut again
MAX_CUTS = 64               # each divides a crowded slice's key range; ends only on keys that cannot be divided

Order = Sequence[tuple[str, bool]]          # (column, descending)


def place_in_range(key: Column, low: Column, high: Column, parts: Column, descending: bool = False) -> Column:
    """Number 0 .. ``parts`` - 1 of the part of [``low``, ``high``] that ``key`` is in; never decreases along the order."""
    x = (key.cast("double") - low.cast("double")) / F.nullif(high.cast("double") - low.cast("double"), F.lit(0.0)) * parts
    place = F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(x, (parts - 1).cast("double")))), F.lit(0)).cast("bigint")
    return parts - 1 - place if descending else place


def _sort_columns(order_by: Order) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order_by]


def _counted(rows: DataFrame, groups: Sequence[str], order_by: Order) -> DataFrame:
    """Rows and key ranges of each slice ``_path``."""
    ranges = [f(c).alias(f"_{n}{k}") for k, (c, _) in enumerate(order_by) for f, n in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy(*groups, "_path").agg(F.count(F.lit(1)).alias("_rows"), *ranges)


def _first_cut(df: DataFrame, order_by: Order, slice_rows: int) -> DataFrame:
    key, down = order_by[0]
    n, low, high = df.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    parts = max(1, -(-n // slice_rows))
    cut = place_in_range(F.col(key), F.lit(low), F.lit(high), F.lit(parts).cast("bigint"), down) if n else F.lit(0).cast("bigint")
    return df.withColumn("_path", F.array(cut))


def _cut_again(rows: DataFrame, crowded: DataFrame, groups: Sequence[str], order_by: Order, slice_rows: int) -> DataFrame:
    parts = F.ceil(F.col("_rows") * 2 / F.lit(slice_rows)).cast("bigint")
    cut = F.lit(0).cast("bigint")
    for k, (key, down) in reversed(list(enumerate(order_by))):
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        cut = F.when(~low.eqNullSafe(high), place_in_range(F.col(key), low, high, parts, down)).otherwise(cut)
    cut = F.concat("_path", F.array(cut))
    return with_slices(rows, crowded, groups).withColumn("_path", cut).select(*rows.columns)


def with_slices(rows: DataFrame, slices: DataFrame, groups: Sequence[str], known_rows: int | None = None) -> DataFrame:
    """``rows`` that are in ``slices`` (``known_rows`` of them, if the caller has counted), with their columns."""
    named = slices.withColumnsRenamed({c: f"_of_{c}" for c in [*groups, "_path"]})
    same = rows["_path"] == named["_of__path"]
    for c in groups:
        same = same & rows[c].eqNullSafe(named[f"_of_{c}"])
    return rows.join(bounded_broadcast(named, pin=False, known_rows=known_rows), same).drop(*[f"_of_{c}" for c in [*groups, "_path"]])


def rank_rows(df: DataFrame, order_by: Order, partition_by: Sequence[str] = (), index_col: str = "idx",
              size_col: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` plus a 0-based ``index_col`` in the order ``order_by`` within ``partition_by`` groups.

    ``order_by`` are numeric columns that with ``partition_by`` are all columns of ``df``, so rows that tie are equal.
    ``size_col`` adds the group's size.
    """
    groups = list(partition_by)
    if set(df.columns) != {*groups, *[c for c, _ in order_by]}:
        raise ValueError("order_by and partition_by must name every column")
    rows, equal = _first_cut(df, order_by, slice_rows), F.lit(True)
    for k in range(len(order_by)):
        equal = equal & F.col(f"_low{k}").eqNullSafe(F.col(f"_high{k}"))
    pieces, tables = [], []
    for depth in range(MAX_CUTS):
        full = (F.col("_rows") > CROWDED * slice_rows) if depth < MAX_CUTS - 1 else F.lit(False)
        slices, seen = materialize_measured(_counted(rows, groups, order_by), full=F.count_if(full), uneven=F.count_if(full & ~equal))
        pieces.append((rows, slices.where(~full), False))
        if seen["full"]:
            pieces.append((rows, slices.where(full & equal), True))
        if not seen["uneven"]:
            break
        rows = _cut_again(rows, slices.where(full & ~equal), groups, order_by, slice_rows)
    for at, (_, slices, fold) in enumerate(pieces):
        tables.append(slices.select(*groups, "_path", "_rows", F.lit(at).alias("_piece")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    before = Window.partitionBy(*groups).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint")))
    if size_col:
        every = every.withColumn(size_col, F.sum("_rows").over(Window.partitionBy(*groups)))
    every = materialize(every) if len(pieces) > 1 else every
    extra = ["_before"] + [size_col] * bool(size_col)
    inside = Window.partitionBy(*groups, "_path").orderBy(*_sort_columns(order_by))
    out = None
    for at, (part, _, fold) in enumerate(pieces):
        own = every.where(F.col("_piece") == at).select(*groups, "_path", *extra)
        found = with_slices(part, own, groups)
        if fold:
            found = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("_copies"))
            found = found.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
        else:
            found = found.withColumn("_at", (F.row_number().over(inside) - 1).cast("bigint"))
        found = found.select(*df.columns, *extra[1:], (F.col("_before") + F.col("_at")).alias(index_col))
        out = found if out is None else out.unionByName(found)
    return out


def first_rows(df: DataFrame, order_by: Order, k: int, partition_by: Sequence[str] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The first ``k`` rows of each group: slices that lie wholly before the cut are taken as they are, and
    only the slice with the cut is ranked."""
    groups, columns = list(partition_by), df.columns
    rows = _first_cut(df, order_by, slice_rows)
    before = Window.partitionBy(*groups).orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    slices = _counted(rows, groups, order_by).select(*groups, "_path", "_rows")
    slices = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint")))
    slices, seen = materialize_measured(slices.where(F.col("_before") < k), cut=F.count_if(F.col("_before") + F.col("_rows") > k))
    whole = with_slices(rows, slices.where(F.col("_before") + F.col("_rows") <= k), groups).select(*columns)
    cut = slices.where(F.col("_before") + F.col("_rows") > k)
    if not seen["cut"]:
        return whole
    within = with_slices(rows, cut.withColumn("_left", k - F.col("_before")).drop("_rows", "_before"), groups).drop("_path")
    ranked = rank_rows(within, order_by, [*groups, "_left"], index_col="_row", slice_rows=slice_rows)
    return whole.unionByName(ranked.where(F.col("_row") < F.col("_left")).select(*columns))
