"""Filter interaction audit (operator 13).

How a set of filters acts together on a table, in every order: what each step removes, what it fails
but an earlier step has removed, what only it fails, and which labelled rows it costs.

* One table of failing ids is stored per filter. Rows get an id of their own first, so repeated document
  ids are no matter. A filter is a condition on a row, or the copy filter: a row fails it if a row with a
  smaller document id has the same text.
* Left-semi and left-anti joins with one id table after the other part the rows by the filters that they
  fail: two joins per filter, on ids alone, however many orders there are. Rows that fail the same
  filters meet the same fate in every order, so they are folded into one class (at most
  ``2 ** len(filters)`` by part) with their counts and, by a left-semi join with each label's ids, those of the labelled rows.
* The prefixes of all orders are worked out by the same joins on classes: survivors are the classes left-anti
  the failing classes of the filters before; removals are survivors left-semi the failing classes of the
  step's filter; what is kept, left-anti these; redundant are the filter's failing classes left-anti the
  survivors; label losses are summed over removals.

Edge cases: a null text is empty: it has no words and no characters. Null parts and the empty string are one
part. A row with a null id fails no copy filter, has no label, and makes no copy of another. Rows with the same id and text
are no copies of each other. A label counts if any label row of that id has it; null labels are none. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, text_of

MIN_WORDS = 200             # A: fewer words
DISTINCT_PERCENT = 50       # B: fewer distinct words than this share of the words
CAPITAL_PERCENT = 3         # C: more A-Z than this share of the characters
MARKS = r"[#$%&*|]"         # D: any of these characters
COPIES = "E"
FILTERS = "ABCDE"
LABELS = {"good_lost": "quality", "toxic_lost": "toxic"}
COUNTS = ("kept", "removed", "redundant", "unique_fails", *LABELS, "shapley")


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions of the filters on one text and its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {"A": n < MIN_WORDS, "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
            "C": 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"), "D": text.rlike(MARKS)}


def audited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(row, id, part, text_hash, A, B, C, D)`` of every row, pinned: ids of rows must not change."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    split = text.withColumn("words", words).withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    fails = text_conditions(F.col("text"), F.col("words"))
    return pinned(split.select(F.monotonically_increasing_id().alias("row"), "id", "part", "text_hash",
                               *[c.alias(k) for k, c in fails.items()]))


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """The stored id table ``(row)`` of each filter."""
    out = {k: pinned(rows.where(k).select("row")) for k in FILTERS if k != COPIES}
    first = pinned(rows.groupBy("text_hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                   .where(F.col("first") < F.col("last")).drop("last"))
    out[COPIES] = pinned(rows.select("row", "id", "text_hash").join(first, "text_hash").where(F.col("id") > F.col("first")).select("row"))
    return out


def classes(rows: DataFrame, fails: dict[str, DataFrame], labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(part, class, n, *LABELS)``: rows by the filters that they fail, as bits in the order of ``fails``."""
    state = rows.select("row", "id", "part", F.lit(0).alias("class"))
    for bit, ids in enumerate(fails.values()):
        lost = state.join(ids, "row", "left_semi").withColumn("class", F.col("class") + (1 << bit))
        state = pinned(lost.unionByName(state.join(ids, "row", "left_anti")))
    counts = {"n": state}
    for name, col in LABELS.items():
        labelled = pinned(labels.where(F.col(col) == 1).select(F.col(id_col).cast("long").alias("id")).distinct())
        counts[name] = state.join(labelled, "id", "left_semi")
    each = [part.select("part", "class", *[F.lit(int(x == name)).cast("long").alias(x) for x in counts]) for name, part in counts.items()]
    summed = each[0]
    for part in each[1:]:
        summed = summed.unionByName(part)
    return pinned(summed.groupBy("part", "class").agg(*[F.sum(x).alias(x) for x in counts]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step`` and ``COUNTS``: one row per part, order of the filters, and step."""
    rows = audited(docs, id_col, text_col, part_col)
    fails = {k: ids for k, ids in sorted(failing_ids(rows).items())}
    folded = classes(rows, fails, labels, id_col)
    return interactions(folded, "".join(fails))


def interactions(folded: DataFrame, filters: str) -> DataFrame:
    """The prefixes of all orders of ``filters`` on classes of rows."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    step = F.explode(F.sequence(F.lit(1), F.lit(len(filters))))
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    one = ["filter_order", "step", "class"]
    bits = F.array(*[F.struct(F.lit(k).alias("filter"), F.lit(1 << at).alias("bit")) for at, k in enumerate(filters)])
    # (filter, class): the classes that fail it
    failing = (folded.select("class").distinct().withColumn("f", F.explode(bits))
               .where(F.col("class").bitwiseAND(F.col("f.bit")) != 0).select("f.filter", "class"))
    every = (folded.withColumn("filter_order", F.explode(orders)).withColumn("step", step).withColumn("filter", letter))
    every = pinned(every)
    prefixes = every.select("filter_order", "step", "filter").distinct()
    earlier = (prefixes.select("filter_order", "step").withColumn("before", F.explode(F.sequence(F.lit(1), F.col("step"))))
               .where(F.col("before") < F.col("step"))
               .withColumn("filter", F.col("filter_order").substr(F.col("before"), F.lit(1))))
    gone = earlier.join(failing, "filter").select(*one).distinct()
    own = prefixes.join(failing, "filter").select(*one).distinct()

    survivors = pinned(every.join(gone, one, "left_anti"))
    removed = survivors.join(own, one, "left_semi")
    kept = survivors.join(own, one, "left_anti")
    redundant = every.join(own, one, "left_semi").join(survivors.select("part", *one), ["part", *one], "left_anti")
    at = {k: 1 << i for i, k in enumerate(filters)}
    only = every.where(F.col("class") == F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[F.col("filter")])

    columns = [c for c in COUNTS if c != "shapley"]
    def part(df, **named):
        return df.select("part", "filter_order", "step", "filter",
                         *[named.get(c, F.lit(0).cast("long")).alias(c) for c in columns])
    n = F.col("n")
    counted = part(every).unionByName(part(kept, kept=n)).unionByName(part(redundant, redundant=n)).unionByName(part(only, unique_fails=n))
    counted = counted.unionByName(part(removed, removed=n, **{x: F.col(x) for x in LABELS}))
    out = pinned(counted.groupBy("part", "filter_order", "step", "filter").agg(*[F.sum(c).alias(c) for c in columns]))
    shapley = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS)


N_ORDERS = factorial(len(FILTERS))

#: DuckDB SQL of ``audit(documents, labels)``.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copied FROM d),
f AS (SELECT part,
        CAST(len(words) < {MIN_WORDS} AS INTEGER) AS a,
        CAST(100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS INTEGER) AS b,
        CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(text) AS INTEGER) AS c,
        CAST(regexp_matches(text, '{MARKS}') AS INTEGER) AS dd,
        CAST(copied AS INTEGER) AS e,
        CAST(coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS INTEGER) AS good,
        CAST(coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS INTEGER) AS toxic
      FROM w),
k AS (SELECT part, a + 2 * b + 4 * c + 8 * dd + 16 * e AS class, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
      FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, bit)),
o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits
      FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.bit | l2.bit | l3.bit | l4.bit | l5.bit = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS gone
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) t),
r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (WHERE class & gone = 0 AND class & bit = 0) AS kept,
        sum(n) FILTER (WHERE class & gone = 0 AND class & bit <> 0) AS removed,
        sum(n) FILTER (WHERE class & gone <> 0 AND class & bit <> 0) AS redundant,
        sum(n) FILTER (WHERE class = bit) AS unique_fails,
        sum(good) FILTER (WHERE class & gone = 0 AND class & bit <> 0) AS good_lost,
        sum(toxic) FILTER (WHERE class & gone = 0 AND class & bit <> 0) AS toxic_lost
      FROM s, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
