from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigstrata.llm import packing as pk
from sigstrata.llm.common import table
from sigstrata.llm.queries import op6_packing
from tests.conftest import SF_ORACLE


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    bounds = pk.optimal_bounds(lengths, counts, buckets)
    k = min(buckets, len(lengths))
    best = min(pk.padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))
    assert pk.padding(lengths, counts, bounds) == best
    assert bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1] and len(bounds) == k


def check(rows, texts, max_tokens, budget):
    """rows of pack() hold every token of ``texts`` (id -> list of texts) once, in full batches."""
    pieces = Counter((r.doc_id, r.piece, r.first_token, r.n_tokens) for r in rows)
    want = Counter()
    for i, all_ in texts.items():
        for t in all_:
            n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
            for p in range(max(1, -(-n // max_tokens))):
                want[i, p, p * max_tokens, min(max_tokens, n - p * max_tokens)] += 1
    assert pieces == want
    bounds = sorted({r.bucket for r in rows})
    lengths = Counter(r.n_tokens for r in rows)
    assert bounds == pk.optimal_bounds(sorted(lengths), [lengths[x] for x in sorted(lengths)], pk.BUCKETS)
    assert all(r.bucket == min(b for b in bounds if b >= r.n_tokens) for r in rows)
    for bound in bounds:
        slots = Counter((r.batch, r.slot) for r in rows if r.bucket == bound)
        fits = budget // max(1, bound)
        n = len(slots)
        assert sum(slots.values()) == n and set(slots) == {(k // fits, k % fits) for k in range(n)}


def test_whole_table(spark):
    docs = {r.doc_id: [r.text] for r in table(spark, SF_ORACLE, "documents").collect()}
    check(op6_packing(spark, SF_ORACLE).collect(), docs, pk.MAX_TOKENS, pk.TOKEN_BUDGET)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "w " * 30_000), (None, "a b c"), (5, "a b"), (5, "a b"), (5, "c")]
    rows += [(i, "same length here") for i in range(100, 400)]
    df = docs(rows).withColumnRenamed("lang", "bucket").withColumnRenamed("source", "_x")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    got = pk.pack(df, max_tokens=1000, token_budget=1000, slice_rows=20)
    check(got.collect(), texts, 1000, 1000)
    assert got.columns == ["doc_id", "_x", "n_chars", *pk.RESULT]
    assert pk.pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pk.pack(df, token_budget=10)


def test_repeated_rows_are_dealt_out_and_columns_of_any_name_are_kept(spark, monkeypatch):
    monkeypatch.setattr(pk, "CROWDED", 2)
    rows = spark.range(3000).selectExpr("7L as doc_id", "'a b c' as text", "'x' as _pk_hash", "'y' as _pk_rows", "1 as `kept _pk_hash`")
    pinned, sizes = pk.pinned, []
    monkeypatch.setattr(pk, "pinned", lambda df: sizes.append(out := pinned(df)) or out)
    got = pk.pack(rows, slice_rows=100, token_budget=2048 * 4)
    assert got.columns == ["doc_id", "_pk_hash", "_pk_rows", "kept _pk_hash", *pk.RESULT]
    out = got.collect()
    assert len({(r.batch, r.slot) for r in out}) == 3000 and {r["_pk_hash"] for r in out} == {"x"} and {r["_pk_rows"] for r in out} == {"y"}
    slices = sizes[-1].collect()
    assert len(slices) > 15 and slices[0]["bucket"] == 3
    check(out, {7: ["a b c"] * 3000}, pk.MAX_TOKENS, 2048 * 4)
