from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigstrata.llm import sentencepiece_sampling as sp
from sigstrata.llm.common import table
from sigstrata.llm.queries import op2_sentencepiece
from tests.conftest import SF_SMALL

V = sp.Vocabulary(sp.read_model())


def ways(text, v=V):
    """Every segmentation of ``" " + text`` into pieces and byte characters: tokens -> log weight."""
    out = {}

    def walk(at, tokens, weight):
        if at == len(text) + 1:
            out[tuple(tokens)] = weight
            return
        whole = " " + text
        if whole[at] not in v.id:
            raw = whole[at].encode()
            walk(at + 1, tokens + [v.byte_id[b] for b in raw], weight + sp.BYTE_LOG_P * len(raw))
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in v.id:
                walk(end, tokens + [v.id[whole[at:end]]], weight + v.log_p[whole[at:end]])

    walk(0, [], 0.0)
    return out


@pytest.mark.parametrize("text,alpha", [("the end", 0.3), ("a  b", 0.1), ("été▁ ok", 0.6), ("x\n\ny", 0.5), ("aaaa", 0.0)])
def test_samples_follow_the_lattice_distribution(text, alpha):
    n = 6000
    got = Counter(tuple(map(int, x)) for x in sp.Sampler(V, alpha).rows(list(range(n)), [text] * n))
    weights = {k: math.exp(alpha * w) for k, w in ways(text).items()}
    total = sum(weights.values())
    assert set(got) <= set(weights)
    # total variation distance, against the size that chance alone gives
    far = sum(abs(got[k] / n - w / total) for k, w in weights.items()) / 2
    chance = sum(math.sqrt(w / total * (1 - w / total) / n) for w in weights.values()) / 2
    assert far < 2 * chance + 1e-9


def test_large_alpha_finds_the_best_segmentation():
    for text in ("there is another", "Donaudampf schiff", "a b c"):
        best = max(ways(text).items(), key=lambda x: x[1])[0]
        assert tuple(next(sp.Sampler(V, 500.0).rows(["k"], [text])).tolist()) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\n\t<0x41></s>")), max_size=30), max_size=5))
def test_decoding_is_lossless(texts):
    keys = list(range(len(texts)))
    ids = list(sp.Sampler(V).rows(keys, texts))
    assert [V.decode(x.tolist()) for x in ids] == texts
    # the same row is segmented alike in any company
    assert all(np.array_equal(next(sp.Sampler(V).rows([k], [t])), x) for k, t, x in zip(keys, texts, ids))


def test_query_is_lossless_and_reproducible(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents").collect()}
    a = {r.doc_id: (list(r.ids), r.n_pieces, r.lossless) for r in op2_sentencepiece(spark, SF_SMALL).collect()}
    assert all(ok and n == len(ids) and V.decode(ids) == docs[i] for i, (ids, n, ok) in a.items()) and len(a) == len(docs)
    again = sp.encode(table(spark, SF_SMALL, "documents").repartition(7)).collect()
    assert {r.doc_id: list(r.ids) for r in again} == {i: x[0] for i, x in a.items()}
    other = sp.encode(table(spark, SF_SMALL, "documents"), seed=1).collect()
    assert sum(list(r.ids) != a[r.doc_id][0] for r in other) > 0.9 * len(docs)


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, " "), (None, "null key"), (None, "null key"), (4, "z" * 50_000), (5, "word " * 60_000)]
    df = docs(rows).withColumnRenamed("lang", "decoded_").withColumnRenamed("source", "seed")
    got = sp.decode(sp.encode(df)).select("doc_id", "text", "decoded", F.size("ids").alias("n")).collect()
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") for r in got)
    assert all((r.n == 0) == (not r.text) for r in got)
    assert sp.encode(df.limit(0)).collect() == []
    twice = [list(r.ids) for r in sp.encode(df).where("doc_id is null").collect()]
    assert twice[0] == twice[1]


def test_columns_of_any_name_are_kept(docs):
    df = docs([(1, "some text"), (2, None)]).selectExpr("*", "1 as _sp_text", "'k' as key", "2 as c0")
    from sigstrata.llm import sentencepiece_sampling
    got = sentencepiece_sampling.encode(df)
    assert got.columns == [*df.columns, "ids"]
    assert sorted((r.doc_id, r.text, r["_sp_text"], r.key, r.c0) for r in got.collect()) == [(1, "some text", 1, "k", 2), (2, None, 1, "k", 2)]
