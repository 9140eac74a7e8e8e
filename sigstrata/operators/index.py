"""Distributed dense row index (D1) over keys of any type, and per-group top-k.

Numeric keys are ranked by slice counts instead (``slices``), without the sorted copy that is kept here.

A window ``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends each whole group to one
task; a group holding a third of the data would then run in one task. Instead:

1. add a tie-breaker, range-partition on ``(group keys, order keys, tie-breaker)`` and sort
   inside partitions, so even one hot key (or a hot group of identical copies) is spread over
   many tasks;
2. tag each row with ``monotonically_increasing_id`` (partition id in the high bits,
   position in the low 33 bits) and pin the result with a reliable checkpoint, so every
   later pass (and any recomputation after an executor loss) sees the same partitions;
3. count rows per (partition, group) -- a table of at most partitions + groups rows -- and
   prefix-sum those counts per group;
4. join the offsets back (broadcast behind a size check) and add them to the position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .joins import bounded_broadcast
from .slices import first_rows

_LOW_BITS = 33


def _tie_breaker(df: DataFrame) -> Column:
    """Hash of the input partition id and the row content.

    Unlike a per-row counter it is stable when a map task is retried on shuffled input (the
    *set* of rows of an input partition is fixed even when their order is not), and it still
    splits a hot group of identical copies across as many ranges as there are input
    partitions; equal tie-breakers only occur for identical rows of one input partition,
    whose relative order does not matter.
    """
    cols = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(F.spark_partition_id(), *cols)


def _sort_expr(c) -> Column:
    return F.col(c).asc() if isinstance(c, str) else c


def with_row_index(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
                   index_col: str = "idx", size_col: str | None = None) -> DataFrame:
    """``df`` plus a 0-based ``index_col`` in ``order_by`` order within ``partition_by`` groups.

    Equal sort keys get distinct consecutive indexes in an arbitrary order. With
    ``size_col`` the group size is added as well. Group keys must be non-NULL.
    """
    keys = [F.col(c).asc() for c in partition_by] + [_sort_expr(c) for c in order_by] + [F.col("_tb").asc()]
    ranged = (df.withColumn("_tb", _tie_breaker(df))
              .repartitionByRange(*keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .drop("_tb"))
    ranged = materialize(ranged).withColumn("_pid", F.shiftright("_mid", _LOW_BITS))

    stats = ranged.groupBy("_pid", *partition_by).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    grp = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()
    stats = stats.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(grp.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0).cast("bigint")))
    if size_col:
        stats = stats.withColumn(size_col, F.sum("_cnt").over(grp))
    stats = stats.drop("_cnt")
    # Recomputing ``stats`` from the pinned data is deterministic, so it needs no checkpoint.
    # Without group keys it has one row per partition: a known bound, broadcast directly.
    small = F.broadcast(stats) if not partition_by else bounded_broadcast(stats)

    out = ranged.join(small, ["_pid", *partition_by])
    out = out.withColumn(index_col, F.col("_mid") - F.col("_first") + F.col("_off"))
    return out.drop("_pid", "_mid", "_first", "_off")


def top_k_per_group(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ascending ``order_by`` order, which with ``partition_by`` names all columns.

    For ``k`` within ``spark.sql.optimizer.windowGroupLimitThreshold`` a ranked window with
    a limit filter is planned as a *partial* WindowGroupLimit before the shuffle: every map
    task keeps only its local top ``k`` per group, so a hot group ships at most ``k`` rows
    per task. Larger ``k`` goes by slice counts.
    """
    k = int(k)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if 0 < k <= limit:
        w = Window.partitionBy(*partition_by).orderBy(*order_by)
        return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.lit(k)).drop("_rank")
    return first_rows(df, [(c, False) for c in order_by], k, partition_by)
