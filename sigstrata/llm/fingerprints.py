"""Document fingerprints by SimHash, and searches within a Hamming radius (operator 3).

Terms are words (lower case, split at white space) and adjacent word pairs. Each term's 64-bit
hash votes on every bit with a signed weight: the damped term count ``1 + ln(count)``, pairs
twice as much as single words since they say more about the text. A bit is 1 where the sum is
positive. Equal texts have equal fingerprints. A text without words has fingerprint zero.

``within_radius`` finds, for query fingerprints, all fingerprints at most ``radius`` bits away, in permuted
block tables: the bits are cut into blocks, and for each choice of blocks there is a table of the fingerprints with
their bits permuted so that the chosen blocks lead. A merge join brings a table and the queries, permuted alike, into
the order of their leading bits, so each query meets the run of rows that share them; these are
verified in whole. Any pair within the radius agrees on the chosen blocks of some table, so none is
missed, and it counts in the first such table. Equal fingerprints are folded before. The rows of a table are dealt into
``SPREAD`` slices and every query looks into each, so a run of many rows is no single task.

``edited`` gives each document the text whose last third is replaced by the beginning of the
next document in descending id order (ties: by the XXH64 of the text, descending, then the text; after the last, the first).
The table is range partitioned by id once; a partition in order knows the next document of all
its rows but the last, which is completed afterwards from the first row of the next partition.

Null texts are empty; rows with a null id come last, in one order with the others. Repeated
rows are kept and follow each other. An empty table gives an empty result, and a table of one
row is followed by itself. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, text_of
from .simhash_dedup import BITS, _signed

RADIUS = 3
RUN = 4             # unrelated fingerprints that may share their leading bits, on average
SPREAD = 8          # slices of a table
DONE, HEAD, TAIL = 0, 1, 2      # a finished row, a partition's first document, its last
_ROW = "doc long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"


def term_weights(text: str) -> tuple[list[bytes], list[float]]:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs: dict[bytes, int] = {}
    for a, b in zip(words, words[1:]):
        p = a + b" " + b
        pairs[p] = pairs.get(p, 0) + 1
    damped = [0.0] + [1 + math.log(n) for n in range(1, 1 + max([0, *counts.values(), *pairs.values()]))]
    weights = [damped[n] for n in counts.values()] + [2 * damped[n] for n in pairs.values()]
    return [*counts, *pairs], weights


def simhash(text: str) -> int:
    """Signed votes of the weighted term hashes, as an unsigned 64-bit fingerprint."""
    terms, weights = term_weights(text)
    if not terms:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(t) for t in terms], "<u8")
    weights = np.array(weights)
    votes = np.zeros(BITS)
    for at in range(0, len(hashes), 1 << 15):
        part = slice(at, at + (1 << 15))
        bits = np.unpackbits(hashes[part].view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += weights[part].astype(np.float32) @ bits.astype(np.float32)
    votes -= weights.sum() / 2
    return int(np.packbits(votes > 0, bitorder="little").view("<u8")[0])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints (0 to 1)."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points of ``following``, or all."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _digest(text: str, fp: int, following: str, next_fp: int) -> tuple:
    new = edit(text, following)
    return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), _signed(fp),
            _signed(fp if new == text else simhash(new)), _signed(next_fp))


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest the rows of a partition in order; its first and last documents come with text."""
    part, last = TaskContext.get().partitionId(), None
    columns = [c.split()[0] for c in _ROW.split(", ")] + ["kind", "part", "text"]
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc"].astype("Int64"), batch["text"]):
            doc, fp = None if doc is pd.NA else int(doc), simhash(text)
            if last is None:
                out.append((doc, None, None, _signed(fp), None, None, HEAD, part, text))
            else:
                out.append((last[0], *_digest(*last[1:], text, fp), DONE, part, None))
            last = doc, text, fp
        yield _frame(out, columns)
    if last:
        yield _frame([(last[0], None, None, _signed(last[2]), None, None, TAIL, part, last[1])], columns)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, n_chars, edited_sha256, fp, edited_fp, next_fp)``, one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    order = [F.col("doc").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc()]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the text itself is no range key: Spark samples the keys to the driver
    made = pinned(rows.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order)
                  .mapInPandas(_follow, f"{_ROW}, kind int, part int, text string"))
    heads = made.where(F.col("kind") == HEAD)
    parts = sorted(r.part for r in heads.select("part").collect())      # one per partition
    after = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    heads = heads.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))

    @F.pandas_udf("n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long")
    def finish(text: pd.Series, fp: pd.Series, next_text: pd.Series, next_fp: pd.Series) -> pd.DataFrame:
        fp, next_fp = (x.astype("int64").astype("uint64") for x in (fp, next_fp))
        done = [_digest(t, int(f), nt, int(nf)) for t, f, nt, nf in zip(text, fp, next_text, next_fp)]
        return pd.DataFrame(done, columns=["n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    tails = (made.where(F.col("kind") == TAIL).select("doc", "part", "text", "fp")
             .join(F.broadcast(after), "part").join(heads, "next")
             .select("doc", finish("text", "fp", "next_text", "next_fp").alias("d")).select("doc", "d.*"))
    return made.where(F.col("kind") == DONE).select(*tails.columns).unionByName(tails)


def block_tables(distinct: int, radius: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``(order, lead)`` of each table: its blocks (first bit, end), chosen ones first, and their bits in all.

    As few blocks as leave at most ``RUN`` of ``distinct`` random fingerprints with the same leading bits.
    """
    if not 0 <= radius < BITS:
        raise ValueError(f"radius must be in 0..{BITS - 1}")
    for n in range(radius + 1, min(BITS, radius + 5) + 1):
        edges = [round(BITS * i / n) for i in range(n + 1)]
        blocks = list(zip(edges, edges[1:]))
        tables = []
        for chosen in combinations(blocks, n - radius):
            tables.append(([*chosen, *(b for b in blocks if b not in chosen)], sum(end - at for at, end in chosen)))
        if distinct <= RUN << min(lead for _, lead in tables):
            break
    return tables


def permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    """``fp`` with its bits in the order of the blocks, the first block in the highest bits."""
    place, out = BITS, F.lit(0).cast("long")
    for at, end in order:
        place -= end - at
        block = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(_signed((1 << (end - at)) - 1)))
        out = out.bitwiseOR(F.shiftleft(block, place))
    return out


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair ``(query_fp, fp, bits)`` with ``bits <= radius`` between the distinct ``fp`` of
    both, found in the permuted block tables."""
    prints, queries = prints.select("fp").distinct(), queries.select(F.col("fp").alias("query_fp")).distinct()
    tables = block_tables(prints.count(), radius)

    def leading(col: Column, order: list[tuple[int, int]], lead: int) -> Column:
        return F.shiftrightunsigned(permuted(col, order), BITS - lead)

    def ordered(df: DataFrame, col: str) -> DataFrame:
        rows = [F.struct(F.lit(t).alias("t"), leading(F.col(col), *table).alias("lead")) for t, table in enumerate(tables)]
        return df.select("*", F.explode(F.array(*rows)).alias("r")).select(*df.columns, "r.*")

    held = ordered(prints.withColumn("slice", F.pmod(F.xxhash64("fp"), F.lit(SPREAD)).cast("int")), "fp")
    asked = ordered(queries.withColumn("slice", F.explode(F.array(*[F.lit(i) for i in range(SPREAD)]))), "query_fp")
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.lit(False)        # this is the first table whose leading bits agree
    for t, table in reversed(list(enumerate(tables))):
        first = F.when(leading(differ, *table) == 0, F.col("t") == t).otherwise(first)
    return (held.join(asked.hint("merge"), ["t", "lead", "slice"])
            .where((F.bit_count(differ) <= radius) & first)
            .select("query_fp", "fp", F.bit_count(differ).alias("bits")))


def count_near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, n_near)``: for each distinct query fingerprint, the rows of ``prints`` within the radius."""
    sizes = pinned(prints.groupBy("fp").agg(F.count("*").alias("rows")))
    return (within_radius(sizes, queries, radius).join(sizes, "fp")
            .groupBy(F.col("query_fp").alias("fp")).agg(F.sum("rows").alias("n_near")))
