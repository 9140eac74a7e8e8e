"""Quality classifier by nearest-neighbour voting on latent-semantic vectors (operator 7).

Texts become counts over hashed terms in three blocks: words, word shapes (case, digits and
punctuation pattern of a word, alone and in adjacent pairs), and repeats (a word equal to one of
the few words before it). Block by block the square roots of the counts are scaled by inverse document
frequency and to a fixed length, and a truncated singular value decomposition, fitted on the
labelled sample, gives dense vectors of length 1.

The labelled vectors (at most ``max_labelled``, as many of either label where there are enough;
those with the smallest hashes of their ids) are broadcast: their size is bounded by that
parameter. Every document is compared with all of them in blocks of exact cosine products. Its
``neighbours`` nearest vote with their labels, weighted by a power of the similarity; a little
weight on the labels' overall share decides where nothing is similar.

Edge cases: a null or empty text has no terms and scores the share of label 1 in the labelled
rows (before balancing). Labels that are null are skipped; if an id has several, their mean counts, and
0.5 or more is label 1. Rows with a null id are scored (and held out is null). Without any
labelled row everything scores 0.5. Repeated rows stay; extra columns are kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORDS, SHAPES, PAIRS, REPEATS = 2048, 512, 512, 4
TERMS = WORDS + SHAPES + PAIRS + REPEATS
BLOCKS = ((0, WORDS, 0.5), (WORDS, WORDS + SHAPES + PAIRS, 1.0), (WORDS + SHAPES + PAIRS, TERMS, 1.0))
MAX_LABELLED = 3000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
CACHED_WORDS = 500_000


def shape(word: str) -> str:
    """Case, digit and punctuation pattern: ``Aa``, ``A!!``, ``a***``, ``9-9``."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(kind * (1 if kind in "Aa9" else min(2, sum(1 for _ in run))) for kind, run in groupby(kinds))


class Terms(dict):
    """word -> word bucket * SHAPES + shape bucket, kept for the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        code = (xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % WORDS * SHAPES
                + xxhash.xxh32_intdigest(shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        self[word] = code
        return code


def term_counts(text: str, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(term ids, counts) of one text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
    word, form = code // SHAPES, code % SHAPES
    at = WORDS + SHAPES + PAIRS
    repeats = [np.full(int((code[k:] == code[:-k]).sum()), at + k - 1) for k in range(1, REPEATS)]
    ids = np.concatenate([word, WORDS + form, WORDS + SHAPES + (form[1:] * 31 + form[:-1]) % PAIRS, *repeats,
                          np.full(max(1, len(words)), at + REPEATS - 1)])
    counts = np.bincount(ids, minlength=TERMS)
    found = np.nonzero(counts)[0]
    return found, counts[found]


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's terms, each block scaled to its length."""
    x = np.sqrt(counts) * idf[ids]
    for start, end, length in BLOCKS:
        a, b = np.searchsorted(ids, (start, end))
        norm = np.sqrt((x[a:b] ** 2).sum())
        if norm:
            x[a:b] *= length / norm
    return x


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray        # TERMS x dimensions
    vectors: np.ndarray     # labelled rows x dimensions, of length 1
    labels: np.ndarray
    share: float            # of label 1 in all labelled rows

    def embed(self, texts, terms: Terms) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), np.float32)
        for row, text in enumerate(texts):
            ids, counts = term_counts(text, terms)
            if len(ids):
                out[row] = weighted(ids, counts, self.idf).astype(np.float32) @ self.axes[ids]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def vote(self, x: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """Scores of the rows of ``x`` from exact cosines with all labelled vectors."""
        out = np.full(len(x), self.share if len(self.labels) else 0.5)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(x) if k else 0, block):
            part = x[at:at + block]
            cosine = part @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(np.float64), 0) ** SHARPNESS
            some = part.any(axis=1)
            score = ((weight * self.labels[near]).sum(axis=1) + 1e-3 * self.share) / (weight.sum(axis=1) + 1e-3)
            out[at:at + block] = np.where(some, np.clip(score, 0, 1), self.share)
        return out


def held_out(id_: Column) -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_labelled: int) -> tuple[list, float]:
    """Term counts and labels of the bounded sample, and the share of label 1 in all its rows."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
             .where(~held_out(F.col("id"))))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    known = known.join(ids, "id", "left_semi")
    size = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size:
        return [], 0.5
    half = max_labelled // 2
    take = {label: min(n, max(half, max_labelled - size.get(1 - label, 0))) for label, n in size.items()}
    order = F.xxhash64("id"), F.col("id")
    chosen = [r.id for label, n in take.items()
              for r in known.where(F.col("label") == label).orderBy(*order).limit(n).select("id").collect()]
    of = {r.id: r.label for r in known.where(F.col("id").isin(chosen)).collect()}

    @F.pandas_udf("ids array<int>, counts array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        terms = Terms()
        return pd.DataFrame([term_counts(t, terms) for t in texts], columns=["ids", "counts"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # of a repeated id, the text that comes first
    picked = picked.where(F.col("id").isin(chosen)).groupBy("id").agg(F.min("text").alias("text"))
    picked = picked.withColumn("t", count("text")).select("id", "t.*")
    first = {r.id: (np.array(r.ids, np.int64), np.array(r.counts, np.int64), of[r.id])
             for r in picked.collect()}
    return [first[i] for i in sorted(first)], size.get(1, 0) / sum(size.values())


def principal(x: np.ndarray, dimensions: int, rounds: int = 10) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration from a fixed start."""
    spare = min(dimensions + 16, *x.shape)
    if not spare:
        return np.zeros((x.shape[1], 1), np.float32)
    basis = np.random.default_rng(0).normal(size=(x.shape[1], spare)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return (basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T)[:, :dimensions].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
        max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS) -> Model:
    rows, share = labelled_sample(docs, labels, id_col, text_col, label_col, max_labelled)
    seen = np.zeros(TERMS)
    for ids, _, _ in rows:
        seen[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    x = np.zeros((len(rows), TERMS), np.float32)
    for row, (ids, counts, _) in enumerate(rows):
        x[row, ids] = weighted(ids, counts, idf)
    axes = principal(x, dimensions)
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), np.array([r[2] for r in rows], float), share)
    z = x @ axes
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    model.vectors = z / np.where(norm > 0, norm, 1)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability-like score of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # TERMS and max_labelled bound its size

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            yield pd.Series(shared.value.vote(shared.value.embed(texts, terms)))

    return docs.withColumn(out, vote(text_of(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row per row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    return score(docs.select(F.col(id_col), F.col(text_col)), model, text_col, "score").select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
