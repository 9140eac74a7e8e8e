from __future__ import annotations

import re
from itertools import permutations
from random import Random

from sigstrata.llm import filter_audit as fa


def fails(rows):
    """The set of filters that each (doc_id, lang, text) fails."""
    out = []
    for i, _, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows) else set()
        out.append(bad)
    return out


def plain(rows, labels):
    """The audit as defined: every order is run, step by step."""
    bad, out = fails(rows), {}
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    for part in {p or "" for _, p, _ in rows}:
        own = [k for k, r in enumerate(rows) if (r[1] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [k for k in left if f in bad[k]]
                left = [k for k in left if f not in bad[k]]
                total[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), sum(f in bad[k] for k in own) - len(lost),
                                                   sum(bad[k] == {f} for k in own), sum(rows[k][0] in good for k in lost),
                                                   sum(rows[k][0] in toxic for k in lost)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def result(df):
    assert df.columns == ["part", "filter_order", "step", *fa.COUNTS]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, row long, class string")


def marks(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_every_order_run_step_by_step(spark):
    random = Random(2)
    long = " ".join(f"w{k}" for k in range(200))
    texts = [long, long + " #", long.upper(), " ".join(["a"] * 250), "short", "SHORT &", long[:-5], long + " end", None, "", " \n\t "]
    rows = [(random.choice([None, *range(40)]), random.choice(["en", "de", "", None]), random.choice(texts)) for _ in range(120)]
    labels = [(random.choice([None, *range(60)]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(50)]
    got, want = result(fa.audit(table(spark, rows), marks(spark, labels))), plain(rows, labels)
    assert got == want and len(got) == 3 * 600
    assert any(v[3] for v in want.values()) and any(v[2] for v in want.values())


def test_edges(spark):
    rows = [(1, "x", "a " * 400_000), (1, "x", "a " * 400_000), (2, "x", "a " * 400_000)]
    none = marks(spark, []).limit(0)
    assert result(fa.audit(table(spark, rows), none)) == plain(rows, [])
    assert fa.audit(table(spark, rows).limit(0), none).collect() == []


def test_conditions_at_their_limits(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:199]), " ".join(words), " ".join(words[:100] * 2), " ".join(words[:99] * 2 + ["x", "x"]),
             "A" * 3 + "a" * 97, "A" * 4 + "a" * 97, " ".join(words), "É" * 50, "a|b", "a\u000bb\u001cc"]
    rows = fa.audited(table(spark, [(k, "", t) for k, t in enumerate(texts)]))
    got = {r.id: {k for k in "ABCD" if r[k]} for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == [f - {"E"} for f in fails([(k, "", t) for k, t in enumerate(texts)])]
