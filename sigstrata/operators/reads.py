"""Viewport curve, keyset pages and overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.args import int_arg, layer_arg, nullable_int
from ..functions.time import bucket_start
from ..schemas import LAYER_BUCKET_MS
from .filters import after_cursor, in_range
from .index import top_k_per_group
from .slices import first_rows, rank_rows

# Limits above this many rows are applied by slice counts, not a top-k.
TOP_K_MAX = 100_000


def page_order():
    """Keyset page order: newest first, ties broken by channel and value."""
    return [F.col("ts").desc(), F.col("channel_id").asc(), F.col("value").asc()]


def signal_range(layer_df: DataFrame, channel_id: int | None, start: int, end: int, layer: str = "L0",
                 limit: int | None = None, align: bool = False, envelope: bool = False,
                 ordered: bool = True) -> DataFrame:
    """Curve points ``ts, value`` of one channel in ``[start, end]`` ordered by ``ts`` (Q1).

    ``layer_df`` is the relation of ``layer``: raw signals for L0, a rollup for L1/L2, where
    ``value`` is the bucket mean (K4) and ``envelope=True`` adds ``min_v``/``max_v``. Rollup
    rows are selected by bucket start (K3); ``align=True`` floors ``start`` to the bucket so a
    bucket straddling ``start`` is kept. ``channel_id=None`` returns every channel (with a
    ``channel_id`` column). ``limit`` is the optional row guard (K22): the earliest rows of each
    channel, ties by value. ``ordered=False`` skips the global sort when the consumer
    re-orders anyway (downsampling).
    """
    layer = layer_arg(layer)
    if layer != "L0" and align:
        start = start - (start % LAYER_BUCKET_MS[layer])
    df = in_range(layer_df, start, end, channel_id)
    cols = [] if channel_id is not None else ["channel_id"]
    value = F.col("value") if layer == "L0" else F.col("avg_v").alias("value")
    cols += ["ts", value]
    if envelope and layer != "L0":
        cols += ["min_v", "max_v"]
    out = df.select(*cols)
    order = ["ts", "value"] if channel_id is not None else ["channel_id", "ts", "value"]
    limit = nullable_int(limit, "limit", minimum=0)
    if limit is not None and channel_id is None:
        rest = [c for c in out.columns if c not in ("channel_id", "ts", "value")]
        out = top_k_per_group(out, ["channel_id"], ["ts", "value", *rest], limit)
        return out.orderBy(*order) if ordered else out
    if limit is not None and limit > TOP_K_MAX:
        # A big row guard through a top-k would merge every partition's top rows in one task.
        order += [c for c in out.columns if c not in order]
        out = first_rows(out, [(c, False) for c in order], limit)
        return out.orderBy(*order) if ordered else out
    if ordered or limit is not None:
        out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def signal_page(sig: DataFrame, limit: int, channel_id: int | None = None, cursor=None,
                compat: bool = False) -> DataFrame:
    """One keyset page ``ts, channel_id, value``, newest first (Q2).

    The order is ``ts DESC, channel_id, value``; ``cursor`` is the last row of the previous
    page as ``(ts, channel_id, value)``. ``compat=True`` uses the reference form ``ts <
    cursor`` (a bare ts is accepted), which skips rows of a tie cut by a page end (K2).
    The plan is a per-partition top-k (``TakeOrderedAndProject``), not a full sort.
    """
    limit = int_arg(limit, "limit", minimum=0)
    df = sig.select("ts", "channel_id", "value")
    channel_id = nullable_int(channel_id, "channel_id")
    if channel_id is not None:
        df = df.filter(F.col("channel_id") == F.lit(channel_id))
    if cursor is not None:
        df = df.filter(after_cursor(cursor, compat))
    return df.orderBy(*page_order()).limit(limit)


def next_cursor(page: DataFrame, limit: int | None = None):
    """Cursor after ``page`` and whether more pages may follow (Q2b). Action on one page.

    With the page's ``limit``, more may follow only if the page is full; without it, if it has rows.
    """
    rows = page.collect()
    if not rows:
        return None, False
    last = rows[-1]
    return (last["ts"], last["channel_id"], last["value"]), limit is None or len(rows) == int(limit)


def assign_pages(sig: DataFrame, limit: int, channel_id: int | None = None) -> DataFrame:
    """Every row with its 0-based ``page`` and ``pos`` in the keyset order (bulk Q2b, by slice counts)."""
    limit = int_arg(limit, "limit", minimum=1)
    df = sig.select("ts", "channel_id", "value")
    if channel_id is not None:
        df = df.filter(F.col("channel_id") == F.lit(int(channel_id)))
    idx = rank_rows(df, [("ts", True), ("channel_id", False), ("value", False)], index_col="row_idx")
    return idx.select("ts", "channel_id", "value",
                      F.floor(F.col("row_idx") / F.lit(limit)).cast("bigint").alias("page"),
                      F.pmod(F.col("row_idx"), F.lit(limit)).cast("bigint").alias("pos"))


def overview(sig: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: ``total_rows, min_ts, max_ts`` (NULL when empty) and ``channels`` (Q7)."""
    chan = channels.select(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("name"))))).scalar()
    return sig.agg(F.count(F.lit(1)).alias("total_rows"), F.min("ts").alias("min_ts"),
                   F.max("ts").alias("max_ts")).select("*", F.coalesce(chan, F.array()).alias("channels"))


def rollup(sig: DataFrame, bucket_ms: int) -> DataFrame:
    """Bucket rollup ``ts, channel_id, avg_v, min_v, max_v, n``."""
    bucket_ms = int_arg(bucket_ms, "bucket_ms", minimum=1)
    return (sig.groupBy(bucket_start("ts", bucket_ms).alias("ts"), "channel_id")
            .agg(F.avg("value").alias("avg_v"), F.min("value").alias("min_v"),
                 F.max("value").alias("max_v"), F.count(F.lit(1)).alias("n")))


def rollup_from_rollup(finer: DataFrame, bucket_ms: int) -> DataFrame:
    """Coarser rollup from a finer one (L2 from L1); means are count-weighted."""
    bucket_ms = int_arg(bucket_ms, "bucket_ms", minimum=1)
    return (finer.groupBy(bucket_start("ts", bucket_ms).alias("ts"), "channel_id")
            .agg((F.sum(F.col("avg_v") * F.col("n")) / F.sum("n")).alias("avg_v"),
                 F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"),
                 F.sum("n").alias("n")))
