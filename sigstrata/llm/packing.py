"""Packing into optimal length buckets (operator 6).

Texts are measured in tokens, cut into pieces of at most ``max_tokens``, and every piece is padded
to the upper bound of its length bucket. Dynamic programming over the global histogram of piece
lengths chooses the bounds that minimise padding: ``cost[b][l]`` is the least padding of all pieces up to
length ``l`` in ``b`` buckets. The histogram has at most ``max_tokens`` entries, whatever the table.

Inside a bucket, batches take as many pieces as fit ``token_budget`` padded tokens. Pieces are
numbered without a global order: a bucket is cut by a hash into slices of about
``slice_rows`` pieces, a slice is numbered alone, and the sums of the slices before it are added. The hash is that of
id, text and piece; a slice that repeated rows make ``CROWDED`` times too large is cut once more, by the rows' places.
All batches of a bucket but its last are full.

A token is a run of characters other than ASCII white space. The measure is a SQL expression, so
another one can be passed.

Edge cases: a null or empty text makes one piece of length 0, in the lowest bucket, and a batch
counts it as one token. A text longer than ``max_tokens`` makes several pieces, none of its
tokens lost. Null and repeated ids are ordinary rows. A length that no piece has needs no bucket: there are
at most as many buckets as lengths. An empty table gives an empty result. Extra columns are kept
(other than those named like a result column, which are replaced).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, sheltered, text_of

MAX_TOKENS = 2048
TOKEN_BUDGET = 65_536
BUCKETS = 16
SLICE_ROWS = 2_000
CROWDED = 8
RESULT = ("piece", "n_tokens", "first_token", "bucket", "batch", "slot")


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_bounds(lengths, counts, buckets: int) -> list[int]:
    """Ascending upper bounds, the last the longest length, of least total padding.

    ``lengths`` ascend. Each row of the table is filled by divide and conquer: the best place of
    the last bound never moves left as the length grows.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    buckets = min(buckets, n)
    best = np.array([0] + [int(lengths[e - 1] * rows[e] - tokens[e]) for e in range(1, n + 1)], np.int64)
    back = np.zeros((buckets + 1, n + 1), np.int64)
    for b in range(2, buckets + 1):
        new = best.copy()
        spans = [(b, n, b - 1, n - 1)]
        while spans:
            lo, hi, first, last = spans.pop()
            if lo > hi:
                continue
            e = (lo + hi) // 2
            starts = np.arange(first, min(last, e - 1) + 1)
            cost = best[starts] + lengths[e - 1] * (rows[e] - rows[starts]) - (tokens[e] - tokens[starts])
            at = int(np.argmin(cost))
            new[e], back[b, e] = cost[at], starts[at]
            spans += [(lo, e - 1, first, int(starts[at])), (e + 1, hi, int(starts[at]), last)]
        best = new
    bounds, e = [], n
    for b in range(buckets, 0, -1):
        bounds.append(int(lengths[e - 1]))
        e = int(back[b, e])
    return bounds[::-1]


def padding(lengths, counts, bounds) -> int:
    """Padded minus real tokens."""
    bounds = np.asarray(bounds)
    return int(sum(c * (bounds[np.searchsorted(bounds, n)] - n) for n, c in zip(lengths, counts)))


def _pieces(docs: DataFrame, tokens: Column, max_tokens: int) -> DataFrame:
    measured = docs.withColumn("_pk_tokens", tokens)
    last = F.greatest(F.lit(0), F.ceil(F.col("_pk_tokens") / max_tokens).cast("int") - 1)
    first = F.col("piece").cast("long") * max_tokens
    return (measured.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("first_token", first)
            .withColumn("n_tokens", F.least(F.lit(max_tokens).cast("long"), F.col("_pk_tokens") - F.col("first_token")))
            .drop("_pk_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
         max_tokens: int = MAX_TOKENS, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per piece: the columns of ``docs`` without the text, and ``RESULT``.

    ``bucket`` is the padded length, ``batch`` counts from 0 inside a bucket, ``slot`` inside a batch.
    """
    if token_budget < max_tokens:
        raise ValueError("token_budget must hold a piece of max_tokens")
    tokens = word_count(text_of(text_col)) if tokens is None else tokens
    docs, back = sheltered(docs.drop(*[c for c in RESULT if c not in (id_col, text_col)]), "_pk_", id_col, text_col)
    rest = [c for c in docs.columns if c != text_col]
    given = [F.col(c).alias(back.get(c, c)) for c in rest]
    measured = (docs.withColumn("_pk_size", tokens.cast("long")).withColumn("_pk_place", F.monotonically_increasing_id())
                .withColumn("_pk_hash", F.xxhash64(F.col(id_col), text_of(text_col))).select(*rest, "_pk_size", "_pk_hash", "_pk_place"))
    pieces = pinned(_pieces(measured, F.col("_pk_size"), max_tokens).drop("_pk_size"))
    histogram = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()    # max_tokens + 1 rows at most
    if not histogram:
        return pieces.select(*given, "piece", "n_tokens", "first_token", F.lit(0).cast("long").alias("bucket"),
                             F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    size = {r.n_tokens: r.n for r in histogram}
    lengths = sorted(size)
    bounds = optimal_bounds(lengths, [size[x] for x in lengths], buckets)

    rows_of, low = {}, -1
    for bound in bounds:
        rows_of[bound] = sum(n for x, n in size.items() if low < x <= bound)
        low = bound
    bucket, slices = F.lit(None).cast("long"), F.lit(None).cast("int")
    for bound in reversed(bounds):
        inside = F.col("n_tokens") <= bound
        bucket = F.when(inside, F.lit(bound).cast("long")).otherwise(bucket)
        slices = F.when(inside, math.ceil(rows_of[bound] / slice_rows)).otherwise(slices)
    placed = (pieces.withColumn("bucket", bucket).withColumn("_pk_hash", F.xxhash64("_pk_hash", "piece"))
              .withColumn("_pk_slice", F.pmod(F.col("_pk_hash"), slices).cast("long")))
    crowded = pinned(placed.groupBy("bucket", "_pk_slice").agg(F.count("*").alias("_pk_rows")).where(F.col("_pk_rows") > CROWDED * slice_rows)
                     .select("bucket", "_pk_slice", F.ceil(F.col("_pk_rows") / slice_rows).alias("_pk_cuts")))
    if crowded.limit(1).count():
        cut = F.pmod(F.xxhash64("_pk_place", "piece"), F.coalesce("_pk_cuts", F.lit(1)))
        placed = (placed.join(crowded, ["bucket", "_pk_slice"], "left")
                  .withColumn("_pk_slice", F.col("_pk_slice") + (1 << 32) * cut).drop("_pk_cuts"))
    sizes = placed.groupBy("bucket", "_pk_slice").agg(F.count("*").alias("_pk_rows"))
    before = Window.partitionBy("bucket").orderBy("_pk_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pinned(sizes.withColumn("_pk_before", F.coalesce(F.sum("_pk_rows").over(before), F.lit(0))).drop("_pk_rows"))
    order = Window.partitionBy("bucket", "_pk_slice").orderBy("_pk_hash", F.col(id_col), "piece")
    number = F.col("_pk_before") + F.col("_pk_row") - 1
    fits = F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1)))
    return (placed.withColumn("_pk_row", F.row_number().over(order)).join(sizes, ["bucket", "_pk_slice"])
            .withColumn("batch", F.floor(number / fits).cast("long")).withColumn("slot", (number % fits).cast("long"))
            .select(*given, "piece", "n_tokens", "first_token", "bucket", "batch", "slot"))
