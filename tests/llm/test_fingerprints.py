from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash

from sigstrata.llm import fingerprints as fp
from sigstrata.llm.common import table
from sigstrata.llm.queries import op3_fingerprints
from tests.conftest import SF_SMALL

U = 2**64 - 1


def plain(rows):
    """rows: (id, text); the digest of each, by a sort of the whole table."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True, key=lambda x: (
        x[0] is not None, x[0] or 0, fp._signed(xxhash.xxh64_intdigest(x[1], 42)), x[1]))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        new = fp.edit(t, n)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.simhash(t), fp.simhash(new), fp.simhash(n)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[:3]) + tuple(x & U for x in r[3:]) for r in df.collect()), key=str)


def test_edit():
    assert fp.edit("abcdefgh", "XYZ") == "abcdefXY" and fp.edit("abcdef", "X") == "abcdX"
    assert fp.edit("ab", "X") == "ab" and fp.edit("", "X") == ""


def test_whole_table_equals_a_plain_sort(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert result(fp.edited(docs)) == plain((r.doc_id, r.text) for r in docs.collect())


def test_edges(docs):
    rows = [(5, None), (5, ""), (5, ""), (None, "lost é 😀 words"), (3, "a " * 50_000), (-2, "one"), (9, "b c d e f g")]
    df = docs(rows).toDF("doc_id", "text", "doc", "fp", "kind")
    assert result(fp.edited(df)) == plain(rows)
    assert result(fp.edited(df.where("doc_id = 9"))) == plain(rows[-1:])
    assert fp.edited(df.limit(0)).collect() == []


def test_likeness_tells_edits_from_strangers(spark):
    rows = [r for r in op3_fingerprints(spark, SF_SMALL).collect() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_search_equals_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    bases = [int(x) for x in rng.integers(0, U, 12, dtype=np.uint64, endpoint=True)]
    all_ = [bases[i % 12] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False))
            for i in range(400)]
    df = spark.createDataFrame([(fp._signed(x),) for x in all_], "fp long")
    queries = spark.createDataFrame([(fp._signed(x),) for x in bases], "fp long")
    got = {(r.query_fp & U, r.fp & U, r.bits) for r in fp.within_radius(df, queries, radius).collect()}
    assert got == {(q, x, (q ^ x).bit_count()) for q in bases for x in all_ if (q ^ x).bit_count() <= radius}
    near = {r.fp & U: r.n_near for r in fp.count_near(df, queries, radius).collect()}
    want = {q: sum((q ^ x).bit_count() <= radius for x in all_) for q in bases}
    assert near == {q: n for q, n in want.items() if n}


@pytest.mark.parametrize("distinct, radius", [(1, 0), (10, 3), (10**7, 3), (10**9, 2), (10**6, 6), (5, 63)])
def test_tables_permute_all_bits_and_cover_every_near_pair(spark, distinct, radius):
    tables = fp.block_tables(distinct, radius)
    assert all(sorted(x for at, end in order for x in range(at, end)) == list(range(64)) for order, _ in tables)
    rng = np.random.default_rng(distinct)
    for _ in range(200):
        differ = {int(x) for x in rng.choice(64, radius, replace=False)}
        assert any(not differ & _leading(order, lead) for order, lead in tables)
    values = [int(x) for x in rng.integers(0, U, 20, dtype=np.uint64, endpoint=True)] + [0, U, 1 << 63]
    df = spark.createDataFrame([(fp._signed(x),) for x in values], "fp long")
    for order, _ in tables[:: max(1, len(tables) // 3)]:
        got = [r[0] & U for r in df.select(fp.permuted(df.fp, order)).collect()]
        want = [int("".join(format(x >> at & (1 << end - at) - 1, f"0{end - at}b") for at, end in order), 2) for x in values]
        assert got == want


def _leading(order, lead):
    out = set()
    for at, end in order:
        if len(out) == lead:
            break
        out |= set(range(at, end))
    return out


def test_a_run_of_equal_leading_bits_is_searched_in_slices(spark):
    crowd = [(5 << 48) + i * 2654435761 % (1 << 40) for i in range(3000)]     # one lead in the first blocks
    asked = [crowd[0], crowd[7] ^ 1, U]
    df = spark.createDataFrame([(fp._signed(x),) for x in crowd], "fp long")
    queries = spark.createDataFrame([(fp._signed(x),) for x in asked], "fp long")
    got = {(r.query_fp & U, r.fp & U) for r in fp.within_radius(df, queries).collect()}
    assert got == {(q, x) for q in asked for x in crowd if (q ^ x).bit_count() <= 3} and len(got) >= 2
    with pytest.raises(ValueError):
        fp.within_radius(df, queries, 64)
