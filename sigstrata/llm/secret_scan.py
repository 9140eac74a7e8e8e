"""Secret scans by rules and character Markov models (operator 4); DataFrame functions only.

Rules find three kinds of spans: ``assign`` (a password-like name, a sign and a value of 6 or more
characters), ``access`` (access key ids of 20 or more) and ``hex`` (runs of 24 or more). The
model adds ``markov`` spans: long runs of key characters that read like random strings rather than like
identifiers. Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples with add-one smoothing; a run's score is the
mean log-likelihood ratio of its transitions, and a score above ``threshold`` is a secret. A run
that overlaps a rule's span is not reported again.

Samples may be any ``(sample, label)`` rows. ``corpus_samples`` takes them from the documents: label
1 are values the rules find, and digests of document ids in base64 and hex; label 0 are words and
identifiers made of neighbouring words (camel and snake case). At most ``max_samples`` of a label are used, those
with the smallest hashes; that bound is the only sampling.

Spans are code points, end exclusive. Positions come from splitting a text at the matches: the
lengths of the gaps and of the matches add up to them.

Edge cases: a null or empty text has no spans. Repeated rows and ids, null ids and other
columns are kept as they are (columns named like a result column are replaced). Without samples of both labels the model
scores everything 0 and adds nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, sheltered, text_of

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
WORD = r"(?<![A-Za-z])[A-Za-z]{4,}(?![A-Za-z])"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIZE = len(SYMBOLS)
MAX_SAMPLES = 4000
THRESHOLD = 0.2
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of the matches; ``keep`` says from (match, position) whether one stays."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits,
                         lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["hit"]).alias("end"))
        return F.struct((begin + x["hit"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["spans"])
    if keep is not None:
        found = F.filter(found, keep)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def rule_spans(text: Column) -> Column:
    """The rules' spans (start, rank, end), ordered by start, then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = _spans(text, ASSIGN, 0, lambda _, at: F.length(F.get(values, at)) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _transitions(sample: Column) -> Column:
    """Indices of the pairs of neighbouring symbols; other characters break a pair."""
    symbols = F.transform(F.split(sample, ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c) - 1)
    pairs = F.zip_with(F.slice(symbols, 1, F.greatest(F.size(symbols) - 1, F.lit(0))), F.slice(symbols, 2, F.size(symbols)),
                       lambda a, b: F.when((a >= 0) & (b >= 0), a * SIZE + b))
    return F.filter(pairs, lambda x: x.isNotNull())


def corpus_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Labelled ``(sample, label)`` rows from the documents, at most ``max_samples`` of a label."""
    docs, text = docs.select(id_col, text_col), text_of(text_col)
    secrets = F.concat(F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")),
                       F.when(text.rlike(HEX), F.regexp_extract_all(text, F.lit(HEX), F.lit(0))).otherwise(F.array().cast("array<string>")))
    digest = F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256)
    drawn = F.array(F.base64(F.unhex(digest)), digest)
    secret = docs.select(F.explode(F.concat(secrets, drawn)).alias("sample")).where(F.length("sample") >= 16)
    # identifiers come from the whole texts of a bounded number of documents
    key = F.col(id_col).alias("_sc_id")
    chosen = docs.select(key).distinct().orderBy(F.xxhash64("_sc_id"), "_sc_id").limit(max_samples // 8)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    names = F.transform(words, lambda w, i: F.when(i % 3 == 0, w).when(
        i % 3 == 1, F.concat_ws("_", F.lower(w), F.lower(F.get("_sc_words", i + 1)), F.lower(F.get("_sc_words", i + 2))))
        .otherwise(F.concat(F.lower(w), F.initcap(F.coalesce(F.get("_sc_words", i + 1), F.lit(""))))))
    plain = (docs.join(F.broadcast(chosen), docs[id_col].eqNullSafe(chosen["_sc_id"]), "left_semi")
             .withColumn("_sc_words", words).select(F.explode(names).alias("sample")).where(F.length("sample") >= 6))
    every = pinned(secret.select("sample", F.lit(1).alias("label")).unionByName(
        plain.select("sample", F.lit(0).alias("label"))).distinct().withColumn("_sc_hash", F.xxhash64("sample")))
    size = {r.label: r.n for r in every.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = every.limit(0)
    for label, n in size.items():
        # hashes are even: about twice the wanted number lie below this one, so few rows are ordered
        top = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * max_samples // n)
        rows = rows.unionByName(every.where((F.col("label") == label) & (F.col("_sc_hash") <= F.lit(top)))
                                .orderBy("_sc_hash", "sample").limit(max_samples))
    return rows.select("sample", "label")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, by index (SIZE * SIZE numbers)."""
    counted = (samples.where(F.col("sample").isNotNull() & F.col("label").isin(0, 1))
               .select("label", F.explode(_transitions(F.col("sample"))).alias("pair"))
               .groupBy("label", "pair").agg(F.count("*").alias("n")).collect())      # 2 * SIZE * SIZE rows at most
    count = {(r.label, r.pair): r.n for r in counted}
    if len({label for label, _ in count}) < 2:
        return [0.0] * (SIZE * SIZE)
    total = {(label, a): sum(count.get((label, a * SIZE + b), 0) for b in range(SIZE)) for label in (0, 1) for a in range(SIZE)}
    log = lambda label, i: math.log((count.get((label, i), 0) + 1) / (total[label, i // SIZE] + SIZE))
    return [round(log(1, i) - log(0, i), 4) for i in range(SIZE * SIZE)]


def ratio(run: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's transitions (0 if it has none)."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    pairs = _transitions(run)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(0.0)


def scan(docs: DataFrame, model: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``rules`` and ``secrets``: spans (start, rank, end) of the rules, and of all kinds."""
    docs, back = sheltered(docs.drop("rules", "secrets"), "_sc_", text_col)
    text = text_of(text_col)
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    random = _spans(text, RUN, 3, lambda _, at: ratio(F.get(runs, at), model) > threshold)
    apart = F.filter(F.col("_sc_runs"), lambda r: ~F.exists(
        "rules", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    return (docs.withColumn("rules", rule_spans(text)).withColumn("_sc_runs", random)
            .withColumn("secrets", F.array_sort(F.concat("rules", apart))).drop("_sc_runs").withColumnsRenamed(back))


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; spans that overlap become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        between = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
