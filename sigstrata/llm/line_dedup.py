"""Line deduplication by pairwise alignment (operator 9).

Documents that share lines are aligned in pairs, and lines of the common blocks are deleted from
the later document (the one with the larger id). Lines are compared without white space at their
ends; blank lines are never compared, and stay. A line is deleted if it is in a common block with any
earlier document; ``partners`` names the documents that the deleted blocks were found with, not all that have them.

* A window is a run of lines that has ``min_words`` words: the shortest from each line on, and the
  shortest up to each line. Every common block is made of windows that both documents have. Windows
  get a 128-bit key of their text, and the earliest document that has one holds it.
* A later document is aligned with the holders of its windows: thousands of documents that share a
  passage make thousands of pairs, not their square, and none is left out, however frequent it is.
* Patience diff: of the lines that stand once in both documents, the longest run that increases in both
  anchors the alignment; between anchors the same again, and where no line stands once in both, the
  occurrences of a line are numbered. Every anchor is extended forwards and backwards over equal
  lines (blank lines aside), whatever else they are aligned with; such a block of at least
  ``min_words`` words is deleted.
* A window that is in no block of the alignment with its holder stands there in another order than the anchors (or
  more often in the later document): a block of its own, deleted as well. So the result is that of all pairs,
  for as many alignments as documents have windows at most.

Edge cases: null or empty text has no lines and stays as it is. Rows equal in id and text are
one document, which is never compared with itself; rows with one id but other texts are ordered by the
hash of the text. Null ids come last. An empty table gives an empty result, and columns beyond
id and text are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, sheltered, text_of

MIN_WORDS = 20
LAST = (1 << 63) - 1        # stands for a null id: after every other


def own_lines(text: str) -> tuple[list[str], list[int], list[int]]:
    """The non-blank lines without white space at their ends, their line numbers and words."""
    found = [(line, at) for at, line in enumerate(map(str.strip, text.split("\n"))) if line]
    return [line for line, _ in found], [at for _, at in found], [len(line.split()) for line, _ in found]


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) place of the shortest runs of ``min_words`` from each line on and up to each line."""
    out, first, total = [], 0, 0
    for last, n in enumerate(words):
        total += n
        if total < min_words and first:
            out.append((first - 1, last))
        while total >= min_words:
            out.append((first, last))
            total -= words[first]
            first += 1
    return out


def _hashed(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass")


def keys(text: str, min_words: int) -> dict[str, list[int]]:
    """What ``LINES`` names: the lines (key, number, words) and the windows (key, first and last line number)."""
    lines, at, words = own_lines(text)
    runs = windows(words, max(1, min_words))
    whole = [xxhash.xxh3_128_intdigest(_hashed("\n".join(lines[a:b + 1]))) for a, b in runs]
    return {"line": [xxhash.xxh3_64_intdigest(_hashed(x)) - (1 << 63) for x in lines], "at": at, "words": words,
            "hi": [(k >> 64) - (1 << 63) for k in whole], "lo": [(k & (1 << 64) - 1) - (1 << 63) for k in whole],
            "first": [at[a] for a, _ in runs], "last": [at[b] for _, b in runs]}


LINES = {"line": np.int64, "at": np.int32, "words": np.int32, "hi": np.int64, "lo": np.int64, "first": np.int32, "last": np.int32}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops, top_at, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _places(lines: list, first: int, stop: int, numbered: bool) -> dict:
    """Place of each line that stands once from ``first`` to before ``stop``, or of each (line, occurrence)."""
    out, seen = {}, {}
    for at in range(first, stop):
        line = lines[at]
        n = seen[line] = seen.get(line, -1) + 1
        if numbered:
            out[line, n] = at
        elif n:
            out.pop(line, None)
        else:
            out[line] = at
    return out


def anchors(own: list, other: list) -> list[tuple[int, int]]:
    """Places (in ``own``, in ``other``) of the aligned lines, in order."""
    out, todo = [], [(0, len(own), 0, len(other))]
    while todo:
        a, a_stop, b, b_stop = todo.pop()
        for numbered in (False, True):
            place = _places(other, b, b_stop, numbered)
            common = [(at, place[x]) for x, at in _places(own, a, a_stop, numbered).items() if x in place]
            if common:
                break
        else:
            continue
        kept = [common[i] for i in longest_increasing([y for _, y in common])]
        out += kept
        ends = [(a - 1, b - 1), *kept, (a_stop, b_stop)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:]) if x + 1 < y and u + 1 < v]
    return sorted(out)


def common_blocks(own: list, other: list, words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) place in ``own`` of the common blocks of at least ``min_words`` words."""
    before, out, reached = [0, *accumulate(words)], [], {}
    for a, b in anchors(own, other):
        shift = b - a
        if reached.get(shift, -1) >= a:
            continue
        first = last = a
        while min(first, first + shift) > 0 and own[first - 1] == other[first - 1 + shift]:
            first -= 1
        while last + 1 < len(own) and last + 1 + shift < len(other) and own[last + 1] == other[last + 1 + shift]:
            last += 1
        reached[shift] = last
        if before[last + 1] - before[first] >= min_words:
            out.append((first, last))
    return out


def _identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_ld_id"),
            F.xxhash64(text_of(text_col)).alias("_ld_text")]


def _line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``(doc, k)``: a document and its ``LINES``."""
    @F.pandas_udf(", ".join(f"{c} array<{'long' if t is np.int64 else 'int'}>" for c, t in LINES.items()))
    def made(texts: pd.Series) -> pd.DataFrame:
        found = [keys(t, min_words) for t in texts]
        return pd.DataFrame({c: pd.Series([np.array(x[c], t) for x in found], dtype=object) for c, t in LINES.items()})

    docs = docs.select(*_identity(id_col, text_col), made(text_of(text_col)).alias("k"))
    # rows equal in id and text are one document
    return pinned(docs.select(F.struct(F.col("_ld_id").alias("id"), F.col("_ld_text").alias("text")).alias("doc"), "k"))


def shared_windows(lines: DataFrame) -> DataFrame:
    """``(hi, lo, doc, first, last, partner)``: the windows of later documents with the earliest document of each."""
    every = (lines.select("doc", F.explode(F.arrays_zip("k.hi", "k.lo", "k.first", "k.last")).alias("w"))
             .select("w.hi", "w.lo", "doc", "w.first", "w.last"))
    holders = (every.groupBy("hi", "lo").agg(F.min("doc").alias("partner"), F.max("doc").alias("end"))
               .where(F.col("partner") != F.col("end")).select("hi", "lo", "partner"))
    return pinned(every.join(pinned(holders), ["hi", "lo"]).where(F.col("doc") != F.col("partner")))


def deleted_lines(own: list, other: list, at: list[int], words: list[int], runs: list[tuple[int, int]], min_words: int) -> list[int]:
    """Line numbers to delete: the blocks aligned with ``other``, and the shared windows ``runs`` (first, last) outside them."""
    out: set[int] = set()
    blocks = sorted((at[a], at[b]) for a, b in common_blocks(own, other, words, min_words))
    starts, reach = [a for a, _ in blocks], list(accumulate((b for _, b in blocks), max))
    for a, b in runs:
        before = bisect_right(starts, a)
        if not before or reach[before - 1] < b:
            blocks.append((a, b))
    for a, b in blocks:
        out.update(at[bisect_left(at, a):bisect_right(at, b)])
    return sorted(out)


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, text_hash, lines, partners)`` of the documents that lose lines."""
    @F.pandas_udf("array<int>")
    def lost(own: pd.Series, at: pd.Series, words: pd.Series, other: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([np.array(deleted_lines(a.tolist(), b.tolist(), n.tolist(), w.tolist(), list(zip(x.tolist(), y.tolist())), min_words), np.int32)
                          for a, n, w, b, x, y in zip(own, at, words, other, first, last)], dtype=object)

    lines = _line_table(docs, id_col, text_col, min_words)
    shared = shared_windows(lines)
    needed = shared.select(F.explode(F.array("doc", "partner")).alias("doc")).distinct()
    lines = pinned(lines.join(needed, "doc", "left_semi")
                   .groupBy("doc").agg(F.first(F.struct("k.line", "k.at", "k.words")).alias("k")))
    pairs = (shared.groupBy("doc", "partner").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
             .select("doc", "partner", F.col("runs.first").alias("first"), F.col("runs.last").alias("last")))
    own = lines.select("doc", F.col("k.line").alias("own"), "k.at", "k.words")
    other = lines.select(F.col("doc").alias("partner"), F.col("k.line").alias("other"))
    found = pinned(pairs.join(own, "doc").join(other, "partner")
                   .select("doc", "partner", lost("own", "at", "words", "other", "first", "last").alias("lines")))
    return (found.groupBy("doc")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
                 F.array_sort(F.collect_set("partner.id")).alias("partners"))
            .select("doc.id", F.col("doc.text").alias("text_hash"), "lines", "partners"))


def remove_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with lines removed from ``text_col``, plus ``deleted_lines`` and ``partners`` (which replace columns of these names)."""
    given = docs.drop("deleted_lines", "partners")
    docs, names = sheltered(given, "_ld_", id_col, text_col)
    found = pinned(deletions(docs, id_col, text_col, min_words)
                   .select(F.col("id").alias("_ld_id"), F.col("text_hash").alias("_ld_text"),
                           F.col("lines").alias("_ld_lines"), F.col("partners").alias("_ld_partners")))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1),
                                 lambda line, at: ~F.array_contains(F.col("_ld_lines"), at.cast("int"))), "\n")
    named = docs.select("*", *_identity(id_col, text_col)).join(found, ["_ld_id", "_ld_text"], "left")
    cut = F.size("_ld_lines") > 0
    return named.select(
        *[F.when(cut, kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c).alias(names.get(c, c)) for c in docs.columns],
        F.coalesce("_ld_lines", F.array().cast("array<int>")).alias("deleted_lines"),
        F.coalesce("_ld_partners", F.array().cast("array<long>")).alias("partners"))
