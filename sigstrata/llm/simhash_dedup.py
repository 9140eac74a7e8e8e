"""SimHash near-duplicate groups by pigeonhole blocks (operator 5).

Texts get a 64-bit fingerprint: lower-case A-Z, split into words at ASCII white space, take
word shingles (repeats included), hash each with XXH64, and set a bit where more than half of
the hashes have it. Fingerprints link when at most ``radius`` bits differ, and groups are the
connected components of those links.

Equal fingerprints are folded first, so a group of exact copies is one representative. The 64
bits are cut into blocks; two fingerprints within ``radius`` bits agree on all but ``radius``
blocks at least, so they meet in the table of some block choice. The number of blocks follows
the number of distinct fingerprints and only changes how many unrelated fingerprints meet. A
bucket with many fingerprints is cut into square tiles, each checked whole, so no task holds a
large bucket and no pair is lost. A tile reports which fingerprints it connects, not every pair.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero, linked like
any other. A text with fewer words than a shingle is hashed as one shingle. Groups are made of
fingerprints, so rows that share an id but not a text are apart. A null id keeps its row and takes the
group of its fingerprint, but is no group id unless no row of the group has one (then the component is
null). An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, pinned, sheltered, text_of

BITS = 64
SEED = 42
TILE = 1024        # fingerprints of one tile side
BUCKET = 4         # unrelated fingerprints a bucket may hold on average


def shingle_hashes(text: str, words: int) -> np.ndarray:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(tokens[i:i + words]), SEED) for i in range(len(tokens) - words + 1)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash of a text column as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([majority_bits(shingle_hashes(t, words)) for t in texts], dtype="uint64").astype("int64")

    return simhash(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def block_masks(distinct: int, radius: int) -> list[int]:
    """Masks of the tables' keys: the fewest blocks that keep chance buckets near ``BUCKET``."""
    blocks = radius + 1
    while blocks < min(BITS, radius + 5) and distinct / 2 ** (BITS * (blocks - radius) // blocks) > BUCKET:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(part, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def tile_links(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """For every id of a tile that links with a smaller one through the tile: (id, smallest)."""
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    if len(ids) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= radius
        return [(int(ids[1]), int(ids[0]))] if near else []
    seen = np.zeros(len(ids), bool)
    out = []
    for start in range(len(ids)):
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            at = front.pop()
            new = np.nonzero((np.bitwise_count(fps ^ fps[at]) <= radius) & ~seen)[0]
            seen[new] = True
            front.extend(new.tolist())
            out.extend((int(ids[i]), int(ids[start])) for i in new)
    return out


def near_links(reps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect what the distances <= ``radius`` in ``reps(fp, rep)`` connect."""
    masks = block_masks(reps.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for t, m in enumerate(masks)])
    keyed = reps.select("fp", "rep", F.explode(tables).alias("k")).select("fp", "rep", "k.t", "k.key")
    sizes = pinned(keyed.groupBy("t", "key").count().where("count > 1"))
    sides = F.ceil(F.col("count") / tile).cast("int")
    side = F.pmod(F.xxhash64("fp", "t"), F.col("sides")).cast("int")
    placed = (keyed.join(sizes, ["t", "key"]).withColumn("sides", sides).withColumn("side", side)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
              .select("t", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                      "fp", "rep"))
    tiles = (placed.groupBy("t", "key", "i", "j")
             .agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
             .where(F.size("fps") > 1).select("fps", "reps"))

    def links(batches):
        for batch in batches:
            out = []
            for fps, reps_ in zip(batch["fps"], batch["reps"]):
                out.extend(tile_links(np.asarray(fps, np.int64).view(np.uint64), np.asarray(reps_, np.int64), radius))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tiles.mapInPandas(links, "a long, b long")


def fingerprint_classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``(fp, class)``: the distinct fingerprints of ``prints(fp)`` with the smallest one that links reach."""
    reps = pinned(prints.select("fp").distinct().select("fp", F.col("fp").alias("rep")))
    linked = components(near_links(reps, radius))
    return pinned(reps.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
                  .select("fp", F.coalesce("component", "rep").alias("class")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                   radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``(id_col, fp, component_id)``."""
    prints = pinned(docs.select(F.col(id_col).cast("long").alias("id"),
                                fingerprint(text_of(text_col), words).alias("fp")))
    ids = prints.groupBy("fp").agg(F.min("id").alias("id")).join(fingerprint_classes(prints, radius), "fp")
    least = ids.groupBy("class").agg(F.min("id").alias("component_id"))
    named = pinned(ids.select("fp", "class").join(least, "class").select("fp", "component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each group: that with the smallest id (null last), then by the hash of its text, then of all columns.

    Rows are told apart by those three, not by the id alone, so rows of one id with unlike texts are apart. Rows equal
    in every column are one.
    """
    docs, back = sheltered(docs, "_sh_", id_col, text_col)
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select("*", F.col(id_col).cast("long").alias("_sh_id"), F.xxhash64(text_of(text_col)).alias("_sh_text"),
                        F.xxhash64(*hashed).alias("_sh_row"))
    key = ["_sh_id", "_sh_text", "_sh_row"]
    prints = pinned(keyed.select(*key, fingerprint(text_of(text_col), words).alias("fp")).groupBy(*key, "fp").agg(F.count("*").alias("n")))
    order = F.struct(F.col("_sh_id").isNull().alias("none"), *key)
    ranked = prints.join(fingerprint_classes(prints, radius), "fp").select("class", order.alias("key"), "n")
    first = ranked.groupBy("class").agg(F.min("key").alias("first"))
    judged = pinned(ranked.join(pinned(first), "class").select("key.*", "n", (F.col("key") == F.col("first")).alias("stays")).drop("none"))

    def matches(some):
        """The condition that a row of ``keyed`` has a key in ``some``; the id may be null."""
        return keyed["_sh_id"].eqNullSafe(some["id"]) & (keyed["_sh_text"] == some["text"]) & (keyed["_sh_row"] == some["row"])

    named = lambda df: df.select(*[F.col(c).alias(c[4:]) for c in key])
    gone = named(judged.where("not stays"))
    kept = keyed.join(gone, matches(gone), "left_anti")
    repeated = named(pinned(judged.where("stays and n > 1")))
    if repeated.limit(1).count():
        several = kept.join(repeated, matches(repeated), "left_semi").dropDuplicates(key)
        kept = kept.join(repeated, matches(repeated), "left_anti").unionByName(several)
    return kept.select(*[F.col(c).alias(back.get(c, c)) for c in docs.columns])
