from __future__ import annotations

import zlib

import numpy as np

from sigstrata.llm import quality_knn as qk
from sigstrata.llm.common import table
from sigstrata.llm.queries import op7_quality
from tests.conftest import SF_ORACLE


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF_ORACLE, "labels").collect()}
    rows = op7_quality(spark, SF_ORACLE).collect()
    assert len(rows) == table(spark, SF_ORACLE, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.97
    assert np.mean([b for a, b in known if a == 0]) < 0.15


def test_vote_equals_brute_force():
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 8)).astype(np.float32))
    model = qk.Model(None, None, unit(50), rng.integers(0, 2, 50).astype(float), 0.7)
    x = np.vstack([unit(40), np.zeros((1, 8), np.float32)])
    want = []
    for row in x:
        near = sorted(((float(row @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:5]
        w = [max(c, 0) ** qk.SHARPNESS for c, _ in near]
        want.append((sum(a * y for a, (_, y) in zip(w, near)) + 1e-3 * 0.7) / (sum(w) + 1e-3) if row.any() else 0.7)
    assert np.allclose(model.vote(x, 5, block=7), want, atol=1e-4)


def test_labels_of_held_out_rows_are_never_learned(spark):
    docs, labels = table(spark, SF_ORACLE, "documents"), table(spark, SF_ORACLE, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    a, b = qk.fit(docs, labels), qk.fit(docs, flipped)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels) and a.share == b.share


def test_edges(spark, docs):
    rows = [(i, f"plain words here number {i}") for i in range(0, 12, 2)] + [(i, f"JUNK!! MORE!! JUNK{i}!!") for i in range(1, 13, 2)]
    rows += [(90, None), (91, ""), (None, "plain words"), (92, "JUNK!! " * 50_000), (93, "JUNK!!"), (93, "JUNK!!")]
    df = docs(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)] + [(0, 1), (1, None), (None, 1), (500, 0)],
                                   "doc_id long, quality int")
    got = qk.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is None and by[None].predicted == 1 and by[92].predicted == 0 and by[93].predicted == 0
    assert by[90].score == by[91].score
    assert {r.score for r in qk.classify(df, labels.limit(0)).collect()} == {0.5}
    assert qk.classify(df.limit(0), labels).collect() == []


def test_principal_axes_span_those_of_the_full_decomposition():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(80, 12)) * 0.7 ** np.arange(12) * 30) @ rng.normal(size=(12, 60)) + rng.normal(size=(80, 60))
    full = np.linalg.svd(x, full_matrices=False)[2][:5].T
    got = qk.principal(x.astype(np.float32), 5, rounds=40)
    assert np.allclose(got @ got.T, full @ full.T, atol=2e-3) and np.allclose(got.T @ got, np.eye(5), atol=1e-4)
    assert qk.principal(np.zeros((0, 7), np.float32), 5).shape == (7, 1)


def test_shape():
    assert [qk.shape(w) for w in ("Word", "WORD!!", "a***", "12.5", "|", "x")] == ["Aa", "A!!", "a**", "9.9", "|", "a"]
