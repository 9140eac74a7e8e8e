from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sigstrata.llm import simhash_dedup as sd
from sigstrata.llm.common import components, table
from tests.conftest import SF_SMALL
from tests.llm.conftest import groups


def plain_fingerprint(text, words=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    tokens = re.findall("[^\x20\x09-\x0d]+", text)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """prints: id -> fingerprint; smallest id reachable."""
    ids = sorted(prints)
    links = [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= radius]
    return groups(links, ids)


def result(df, id_col="doc_id"):
    return {r[id_col]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    roots = plain_groups(want)
    assert result(sd.simhash_groups(docs)) == {i: (f, roots[i]) for i, f in want.items()}


def test_edges_nulls_empty_short_repeated_and_extra_columns(spark, docs):
    rows = [(9, None), (4, ""), (7, " \t\n"), (3, "One"), (5, "one"), (6, "É A"), (8, "é a"), (2, "x " * 40_000),
            (3, "One")]
    df = docs(rows).toDF("doc_id", "text", "fp", "component_id", "rep")
    got = sorted((r.doc_id, r.component_id) for r in sd.simhash_groups(df).collect())
    assert got == [(2, 2), (3, 3), (3, 3), (4, 4), (5, 3), (6, 6), (7, 4), (8, 8), (9, 4)]
    assert sd.simhash_groups(df.limit(0)).collect() == []


def test_null_id_keeps_its_row(docs):
    got = sorted(map(str, [tuple(r) for r in sd.simhash_groups(docs([(None, "a b c"), (1, "a b c"), (None, "q")]))
                           .select("doc_id", "component_id").collect()]))
    assert got == sorted(map(str, [(None, 1), (1, 1), (None, None)]))


@pytest.mark.parametrize("tile", [4, 1024])
def test_dense_bucket_in_tiles_equals_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    prints = {}
    for i in range(300):   # balls of near fingerprints and far ones
        base = int(rng.integers(0, 4)) * 0x1234_5678_9ABC_DEF1 & (2**64 - 1)
        flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
        fp = base ^ sum(1 << int(b) for b in flips)
        if fp not in prints.values():
            prints[i] = fp
    reps = spark.createDataFrame([(sd._signed(f), i) for i, f in prints.items()], "fp long, rep long")
    got = {r.node: r.component for r in components(sd.near_links(reps, tile=tile)).collect()}
    want = plain_groups(prints)
    assert {i: got.get(i, i) for i in prints} == want


@pytest.mark.parametrize("distinct", [1, 10**6, 10**9])
def test_close_pairs_share_a_block(distinct):
    masks = sd.block_masks(distinct, 3)
    rng = np.random.default_rng(1)
    for _ in range(200):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}
    assert components(df.limit(0)).collect() == []
