"""Source divergence audit (operator 12).

For every language, the terms of each source are compared with those of every other source and of the
language as a whole, by smoothed integer frequencies (parts per ``SCALE``).

* Partial counts: Arrow compute functions inside ``mapInArrow``. ``ascii_lower``, ``split_pattern_regex``
  and ``dictionary_encode`` turn slices of at most ``SLICE_BYTES`` of text into term codes, and hash group_by
  counts them, first by document, then by language and source: occurrences, and documents that hold the
  term. A task merges its slices, and hands on what it has when that grows beyond ``HELD_ROWS``.
* Spark adds the partial counts up (with a map-side combine), keeps the terms that are in at least
  ``min_docs`` documents of their language, and deals these out by a hash into columnar shards of about
  ``SHARD_TERMS`` terms of a language. Languages of many sources also deal these out into sides of about
  ``SIDE_SOURCES``, so that a shard holds two sides at most, whatever the number of sources.
* A shard is a matrix of sources and terms. It adds up the distances of its pairs of sources, and ranks its
  own terms; the sums and the ranks of all shards are merged by Spark. Terms that no source of a
  shard has are not in its matrix: all sources have their smallest frequency there, and that
  distance is counted once, in shard 0.

All arithmetic is in whole numbers, and frequencies are divided three digits at a time, so counts up to
9e15 are exact.

Edge cases: null text, language and source are read as empty strings. A text without terms counts for its
group only; a group without kept terms has the frequencies of the smoothing alone. A language of one
source has no pairs. A language without kept terms has its pairs with value 0 and no terms. Repeated rows
are documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, text_of

#: Fixed: what stands between terms, runs of ASCII characters other than letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
SMOOTHING = 5
MIN_DOCS = 30
TOP_TERMS = 50
SLICE_BYTES = 16 << 20
HELD_ROWS = 1_000_000
SHARD_TERMS = 4096
SIDE_SOURCES = 128

COUNTS = "lang string, source string, term string, n long, docs long"
KEYS = ["lang", "source", "term"]


def slice_ends(texts: pa.Array) -> list[int]:
    """Row numbers that cut ``texts`` into slices of about ``SLICE_BYTES``."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.nonzero(np.diff(total // SLICE_BYTES))[0] + 1
    return [*cuts.tolist(), len(texts)]


def slice_counts(batch: pa.RecordBatch) -> pa.Table:
    """``COUNTS`` of one slice; the empty term stands for the group itself."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), len(source.dictionary)), source.indices.cast(pa.int64()))
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), SEPARATORS)
    terms = words.flatten().dictionary_encode()
    doc = pc.list_parent_indices(words)
    by_doc = pa.table({"doc": doc, "term": terms.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
    found = (pa.table({"group": group.take(by_doc["doc"]), "term": by_doc["term"], "n": by_doc["count_all"]})
             .group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")]))
    code = found["group"].combine_chunks()
    own = pc.unique(group)
    out = pa.table({"lang": _named(lang.dictionary, pc.divide(code, len(source.dictionary))),
                    "source": _named(source.dictionary, _rest(code, len(source.dictionary))),
                    "term": _named(terms.dictionary, found["term"].combine_chunks()), "n": found["n_sum"], "docs": found["n_count"]})
    out = out.filter(pc.not_equal(out["term"], ""))
    none = pa.array(np.zeros(len(own), np.int64))
    groups = pa.table({"lang": _named(lang.dictionary, pc.divide(own, len(source.dictionary))),
                       "source": _named(source.dictionary, _rest(own, len(source.dictionary))),
                       "term": pa.array([""] * len(own), pa.string()), "n": none, "docs": none})
    return pa.concat_tables([out, groups])


def _named(dictionary: pa.Array, codes: pa.Array) -> pa.Array:
    return dictionary.take(codes)


def _rest(codes: pa.Array, n: int) -> pa.Array:
    return pc.subtract(codes, pc.multiply(pc.divide(codes, n), n))


def merged(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([*KEYS, "n", "docs"])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        start = 0
        for end in slice_ends(batch.column("text")):
            part = slice_counts(batch.slice(start, end - start))
            start = end
            held.append(part)
            rows += len(part)
            if rows > HELD_ROWS:
                held = [merged(held)]
                rows = len(held[0])
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
    if held:
        yield from merged(held).to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``COUNTS`` of the whole table; the row with the empty term stands for the group itself."""
    read = docs.select(*[text_of(c).alias(name) for name, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    return read.mapInArrow(partial_counts, COUNTS).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTHING) / total)``, exact."""
    out, rest = np.divmod(count + SMOOTHING, total)
    for _ in range(3):                      # SCALE is 1000 ** 3
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _best(value: np.ndarray, item: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest values, ties by item in ascending order."""
    if len(value) > top:
        least = np.partition(value, len(value) - top)[len(value) - top]
        place = np.nonzero(value >= least)[0]
    else:
        place = np.arange(len(value))
    return place[np.lexsort((item[place], -value[place]))][:top]


def shard_divergence(key: tuple, counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Distances of the pairs (first source before the second) and the best terms of one shard."""
    shard, a, b = (k.as_py() for k in key[1:])
    name = groups["source"].to_pylist()
    order = sorted(range(len(name)), key=lambda k: name[k].encode("utf-8", "surrogatepass"))
    name = [name[k] for k in order]
    size, side = (groups[c].to_numpy()[order] for c in ("n_group", "side"))
    kept, total = int(groups["kept"][0].as_py()), int(groups["n_lang"][0].as_py())
    out = {"source": [], "part": [], "item": [], "value": []}
    if kept:
        terms = counts["term"].combine_chunks().dictionary_encode()
        text = terms.dictionary.to_pylist()
        column = terms.indices.to_numpy()
        place = {s: k for k, s in enumerate(name)}
        row = np.fromiter((place[s] for s in counts["source"].to_pylist()), np.int64, len(counts))
        n = np.zeros((len(name), len(text)), np.int64)
        n[row, column] = counts["n"].to_numpy()
        whole = np.zeros(len(text), np.int64)
        whole[column] = counts["total"].to_numpy()
        share = frequency(n, size[:, None] + SMOOTHING * kept)
        none = frequency(np.zeros(len(name), np.int64), size + SMOOTHING * kept)
    for i in range(len(name)):
        # a pair is summed in the one shard of its two sides
        later = np.arange(i + 1, len(name))
        later = later[(np.minimum(side[later], side[i]) == a) & (np.maximum(side[later], side[i]) == b)]
        value = np.zeros(len(later), np.int64)
        if kept:
            apart = np.abs(none[later] - none[i])
            value = np.abs(share[later] - share[i]).sum(axis=1) - len(text) * apart + (kept * apart if shard == 0 else 0)
        out["source"] += [name[i]] * len(later)
        out["part"] += ["pair"] * len(later)
        out["item"] += [name[k] for k in later]
        out["value"].append(value)
        if kept and a == b:
            above = share[i] - frequency(whole, np.int64(total + SMOOTHING * kept))
            found = np.nonzero((n[i] > 0) & (above > 0))[0]
            item = np.array([text[k].encode("utf-8", "surrogatepass") for k in found], object)
            found = found[_best(above[found], item, top)]
            out["source"] += [name[i]] * len(found)
            out["part"] += ["term"] * len(found)
            out["item"] += [text[k] for k in found]
            out["value"].append(above[found])
    value = np.concatenate([np.zeros(0, np.int64), *out["value"]])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(value), pa.string()), "source": pa.array(out["source"], pa.string()),
                     "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": value})


def _dealt(n: Column, least: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / least)).cast("int")


def _place(col: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(col), F.col(parts)).cast("int")


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, shard_terms: int = SHARD_TERMS,
                side_sources: int = SIDE_SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: the sources most unlike a source, and the terms that it has more of."""
    counts = pinned(term_counts(docs, text_col, lang_col, source_col))
    kept = pinned(counts.where("term <> ''").groupBy("lang", "term")
                  .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs))
    found = pinned(counts.join(kept.select("lang", "term", "total"), ["lang", "term"]))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang")), "lang", "left")
    langs = pinned(langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"),
                                _dealt(F.col("sources"), side_sources).alias("sides"),
                                _dealt(F.coalesce("kept", F.lit(0)), shard_terms).alias("shards")))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda other: F.struct(
        F.least("side", other).alias("a"), F.greatest("side", other).alias("b"))))
    rows = (found.join(langs.select("lang", "sides", "shards"), "lang")
            .select("lang", _place("term", "shards").alias("shard"), _place("source", "sides").alias("side"), "sides",
                    "source", "term", "n", "total").withColumn("t", tiles)
            .select("lang", "shard", "t.a", "t.b", "source", "term", "n", "total"))
    members = (groups.join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
               .withColumn("side", _place("source", "sides")).withColumn("t", tiles)
               .withColumn("n_group", F.coalesce("n_group", F.lit(0))).select("*", "t.*"))
    # new names for the same columns: both sides come from one table
    members = members.select(*[F.col(c).alias(c) for c in ("lang", "shard", "a", "b", "source", "side", "n_group", "kept", "n_lang")])
    keys = ["lang", "shard", "a", "b"]

    def shard(key, left, right):
        return shard_divergence(key, left, right, top_terms)

    parts = pinned(rows.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(
        shard, "lang string, source string, part string, item string, value long"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    terms = ranked(parts.where("part = 'term'")).where(F.col("rank") <= top_terms)
    return ranked(pairs).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


#: DuckDB SQL of ``divergences(documents)``.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
           FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.term, f.n,
             1 + CAST({SCALE} AS HUGEINT) * (f.n + {SMOOTHING}) // (s.n + {SMOOTHING} * v.v) AS p,
             1 + CAST({SCALE} AS HUGEINT) * (f.total + {SMOOTHING}) // (v.n + {SMOOTHING} * v.v) AS q
      FROM f JOIN s ON s.lang = f.lang AND s.source = f.source JOIN v ON v.lang = f.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
      FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
      LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
