from __future__ import annotations

import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sigstrata.llm import source_divergence as sd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    """(lang, source, text) -> the rows of the audit, straight from its definition."""
    count, held, groups = Counter(), defaultdict(set), set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            count[lang, source, term] += 1
            held[lang, term].add(k)
    out = []
    for lang, source in groups:
        kept = [t for (x, t), docs in held.items() if x == lang and len(docs) >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(some):
            n = {t: sum(count[lang, s, t] for s in some) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        p, q = shares([source]), shares(sources)
        pairs = [(-sum(abs(p[t] - r[t]) for t in kept), s.encode(), s) for s in sources if s != source for r in [shares([s])]]
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if count[lang, source, t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string")


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def some_rows(seed, n):
    random = Random(seed)
    words = ["Haus", "haus", "HAUS", "été", "ÉTÉ", "naïve", "x", "don't", "a1b", "日本", "Ⅻ", "ß", "zz\x00y", "\x80q"]
    source = [f"s{k}" for k in range(9)] + ["é", "Z", None, ""]
    return [(random.choice(["en", "de", "", None]), random.choice(source),
             random.choice([None, "", " 12 ", " ".join(random.choices(words, k=random.randint(1, 30)))])) for _ in range(n)]


def test_equals_definition_in_shards_and_sides(spark):
    rows = some_rows(3, 200)
    got = sd.divergences(table(spark, rows), min_docs=6, top_terms=4, shard_terms=3, side_sources=2)
    want = plain(rows, 6, 4)
    assert result(got) == want and {r[2] for r in want} == {"pair", "term"}
    assert result(sd.divergences(table(spark, rows), min_docs=6, top_terms=4)) == want


def test_edges(spark):
    rows = [("en", "a", "one two"), ("en", "a", "one two"), ("en", "b", None), (None, None, "one"), ("de", "only", "w " * 300_000)]
    assert result(sd.divergences(table(spark, rows), min_docs=2)) == plain(rows, 2, 50)
    none = sd.divergences(table(spark, rows), min_docs=3)
    assert result(none) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == plain(rows, 3, 50)
    assert result(sd.divergences(table(spark, rows).limit(0))) == []


def test_slices_and_flushes_lose_nothing(monkeypatch):
    monkeypatch.setattr(sd, "SLICE_BYTES", 40)
    monkeypatch.setattr(sd, "HELD_ROWS", 8)
    rows = some_rows(5, 150)
    batch = pa.table({"text": [t or "" for _, _, t in rows], "lang": [x or "" for x, _, _ in rows], "source": [s or "" for _, s, _ in rows]})
    parts = [r for b in sd.partial_counts(iter(batch.to_batches(max_chunksize=20))) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for r in parts:
        n[r["lang"], r["source"], r["term"]] += r["n"]
        docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want = [[(x or "", s or "", w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))] for x, s, t in rows]
    assert {k: v for k, v in n.items() if k[2]} == Counter(w for ws in want for w in ws)
    assert {k: v for k, v in docs.items() if k[2]} == Counter(w for ws in want for w in set(ws))
    assert {k[:2] for k in n if not k[2]} == {(x or "", s or "") for x, s, _ in rows}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(0, 8 * 10**15))
def test_frequency_is_exact(count, more):
    total = count + 5 + more
    got = sd.frequency(np.array([count]), np.array([total]))[0]
    assert int(got) == 1 + 10**9 * (count + 5) // total
