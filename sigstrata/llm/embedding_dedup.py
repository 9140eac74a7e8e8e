"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 10).

Every pair of vectors with cosine >= ``threshold`` is linked, whatever its labels; groups are
the connected components. Cosines are exact, in double precision.

* Equal vectors are folded first and counted, so a group of copies is one representative.
* Unit vectors are rotated onto the principal axes of the whole table (second moments summed in
  Spark; only dim x dim numbers reach the driver). The rotation keeps every product.
* Vectors are range partitioned by their first principal coordinate into small packed blocks.
  Blocks make up strips of about ``strip`` rows; two strips are compared only if their first
  coordinates come within the distance that the cosine allows.
* A tile (a pair of strips) multiplies the leading dimensions first. Of the rest of each vector
  only the norm is used: by Cauchy-Schwarz the residual product is at most the product of the
  suffix norms, so a pair stops when leading product plus that bound is below the threshold.
  The suffix norm rides along as one more dimension, so the bound is a single matrix product.
  Pairs that remain go on to more dimensions and at last to the exact product.
* A tile reports each vector's number of links and which vectors it connects, not every pair.

Edge cases: vectors that are null, empty, all zero, or hold a null or non-finite component link
with nothing (no links, their own component, kept). Vectors of different length never link.
Repeated ids stay separate rows; they count as links of each other if their vectors are close.
A null id keeps its row and its links are counted, but it names no component unless alone (then
the component is null and ``kept`` is null). Extra columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, pinned

THRESHOLD = 0.95
STRIP = 4096            # rows of a tile's side
LEADS = (0.12, 0.4)     # shares of the dimensions multiplied before the exact product
SLACK = 1e-5            # float32 rounding that the bounds allow for
ROWS_AT_ONCE = 512
TASK_TILES = 4


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1 (scaled twice, so huge or tiny rows are safe)."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """dim x dim rotation, columns by descending second moment of the unit vectors."""
    upper = np.triu_indices(dim)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit_rows(np.stack(batch["v"]))
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(upper[0])), "x": total[upper]})

    sums = reps.select("v").mapInPandas(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    matrix = np.zeros((dim, dim))
    for r in sums.collect():        # dim * (dim + 1) / 2 numbers
        matrix[upper[0][r.i], upper[1][r.i]] = matrix[upper[1][r.i], upper[0][r.i]] = r.x
    return np.linalg.eigh(matrix)[1][:, ::-1].copy()


def _packed(reps: DataFrame, axes: np.ndarray, blocks: int, strip: int) -> DataFrame:
    """Rows ``(part, n, low, high, ids, copies, vectors)`` ordered by the first coordinate."""
    first = axes[:, 0]

    @F.pandas_udf("double")
    def lead(v: pd.Series) -> pd.Series:
        return pd.Series(unit_rows(np.stack(v)) @ first if len(v) else [], dtype="float64")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), strip):
                rows = batch.iloc[at:at + strip]
                yield pd.DataFrame({
                    "part": [part], "n": [len(rows)], "low": [rows["lead"].min()], "high": [rows["lead"].max()],
                    "ids": [rows["rep"].to_numpy("int64").tobytes()], "copies": [rows["copies"].to_numpy("int64").tobytes()],
                    "vectors": [np.stack(rows["v"]).astype(np.float64).tobytes()]})

    order = ["lead", F.xxhash64("rep")]     # equal coordinates are spread by their ids
    return (reps.withColumn("lead", lead("v")).repartitionByRange(blocks, *order)
            .select("lead", "rep", "copies", "v")
            .mapInPandas(pack, "part int, n int, low double, high double, ids binary, copies binary, vectors binary"))


def _leads(dim: int) -> list[int]:
    return sorted({max(1, min(dim, round(dim * s))) for s in LEADS})


def _augmented(x: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` columns and the norm of the others."""
    rest = np.sqrt(np.maximum(0, (x[:, k:] * x[:, k:]).sum(axis=1, keepdims=True)))
    return np.hstack([x[:, :k], rest]).astype(np.float32)


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Index arrays (i, j) of rows of unit ``x`` and ``y`` with cosine >= threshold, in pieces."""
    rx, ry = x @ axes, y @ axes
    steps = [(_augmented(rx, k), _augmented(ry, k)) for k in _leads(x.shape[1])]
    for at in range(0, len(x), ROWS_AT_ONCE):
        own = np.arange(at, min(at + ROWS_AT_ONCE, len(x)))
        a, b = steps[0]
        i, j = np.nonzero(a[own] @ b.T >= threshold - SLACK)
        for a, b in steps[1:]:
            if len(i) > 4 * ROWS_AT_ONCE:       # many remain: multiply the rows and columns that do
                rows, cols = np.unique(i), np.unique(j)
                part = a[own[rows]] @ b[cols].T >= threshold - SLACK
                keep = part[np.searchsorted(rows, i), np.searchsorted(cols, j)]
            else:
                keep = np.einsum("ij,ij->i", a[own[i]], b[j]) >= threshold - SLACK
            i, j = i[keep], j[keep]
        for part in range(0, len(i), 1 << 16):
            p, q = own[i[part:part + (1 << 16)]], j[part:part + (1 << 16)]
            fine = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            yield p[fine], q[fine]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable of each of ``n`` nodes over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        new = root.copy()
        np.minimum.at(new, a, b)
        np.minimum.at(new, b, a)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
    return root


def tile_result(left: list, right: list | None, axes: np.ndarray, threshold: float) -> tuple:
    """Of one tile: rep ids, their linked vectors (copies counted), smallest rep id connected."""
    def whole(side):
        ids = np.concatenate([np.frombuffer(s["ids"], np.int64) for s in side])
        copies = np.concatenate([np.frombuffer(s["copies"], np.int64) for s in side])
        return ids, copies, unit_rows(np.concatenate(
            [np.frombuffer(s["vectors"], np.float64).reshape(-1, len(axes)) for s in side]))

    ids, copies, x = whole(left)
    y, shift = x, 0
    if right is not None:
        more, more_copies, y = whole(right)
        shift = len(ids)
        ids, copies = np.concatenate([ids, more]), np.concatenate([copies, more_copies])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for i, j in close_pairs(x, y, axes, threshold):
        if right is None:
            above = i < j
            i, j = i[above], j[above]
        j = j + shift
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        # fold the links found so far into a forest, so no list of all pairs is held
        a, b = root[place[i]], root[place[j]]
        differ = a != b
        root = _roots(len(ids), np.concatenate([np.arange(len(ids)), a[differ]]),
                      np.concatenate([root, b[differ]]))
    found = links > 0
    return ids[found], links[found], ids[order][root[place]][found]


def _strips(rows: list, strip: int) -> tuple[dict[int, int], list[tuple[float, float]]]:
    """part -> strip, and each strip's range of first coordinates; rows: (part, n, low, high)."""
    of, ranges, size = {}, [], 0
    for part, n, low, high in sorted(rows):
        if not ranges or size + n > 1.25 * strip:
            ranges.append((low, high))
            size = 0
        size += n
        of[part] = len(ranges) - 1
        ranges[-1] = (min(ranges[-1][0], low), max(ranges[-1][1], high))
    return of, ranges


def close_vectors(reps: DataFrame, dim: int, threshold: float = THRESHOLD, strip: int = STRIP) -> DataFrame:
    """``(rep, links, root)`` of tiles over ``reps(rep, copies, v)``, all of length ``dim``."""
    spark = reps.sparkSession
    axes = principal_axes(reps, dim)
    n = reps.count()
    blocks = max(1, math.ceil(n / strip))
    packed = pinned(_packed(reps, axes, blocks, strip))
    parts = [tuple(r) for r in packed.groupBy("part").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]
    of, ranges = _strips(parts, strip)              # one entry per partition
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    last = [max(j for j in range(i, len(ranges)) if ranges[j][0] - ranges[i][1] <= reach) for i in range(len(ranges))]
    # a strip goes to the tiles of its partners: as the left side up to `last`, as the right from `since`
    since = [min(i for i in range(j + 1) if last[i] >= j) for j in range(len(ranges))]
    where = spark.createDataFrame([(p, s, last[s], since[s]) for p, s in of.items()],
                                  "part int, strip int, last int, since int")
    tile = F.transform(F.sequence("since", "last"), lambda o: F.struct(
        F.least("strip", o).alias("i"), F.greatest("strip", o).alias("j"), (F.col("strip") <= o).alias("left")))
    n_tiles = sum(e - i + 1 for i, e in enumerate(last))
    sides = (packed.join(F.broadcast(where), "part").select(F.explode(tile).alias("tile"), "ids", "copies", "vectors")
             .select("tile.*", "ids", "copies", "vectors"))
    # few tiles in a task: an Arrow batch holds all of them
    tiles = (sides.repartition(math.ceil(n_tiles / TASK_TILES), "i", "j").groupBy("i", "j")
             .agg(F.collect_list(F.struct("left", "ids", "copies", "vectors")).alias("sides")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j, sides in zip(batch["i"], batch["j"], batch["sides"]):
                right = None if i == j else [s for s in sides if not s["left"]]
                ids, links, root = tile_result([s for s in sides if s["left"]], right, axes, threshold)
                yield pd.DataFrame({"rep": ids, "links": links, "root": root})

    return tiles.mapInPandas(compare, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, strip: int = STRIP) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    valid = rows.where(_valid(F.col("v")))
    # a representative is named by its smallest id; classes whose ids are all null get names below all ids
    classes = valid.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = classes.withColumn("rep", F.coalesce("id", -(F.pmod(F.xxhash64("v"), F.lit(1 << 62)) + (1 << 62))))
    classes = pinned(classes)
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        one = close_vectors(classes.where(F.size("v") == dim).select("rep", "copies", "v"), dim, threshold, strip)
        found = one if found is None else found.unionByName(one)
    if found is None:
        named = classes.select("v", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    else:
        found = pinned(found)
        groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        named = (classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id")))
    out = rows.where(_valid(F.col("v"))).join(pinned(named), "v").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_valid(F.col("v")), F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    nameless = F.col("component_id") <= -(1 << 62)
    return out.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.when(~nameless, F.col("component_id")).alias("component_id"),
        F.when(~nameless, F.col("component_id") == F.col("id")).alias("kept"))
