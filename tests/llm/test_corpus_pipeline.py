from __future__ import annotations

import re

import pytest

import corpus_pipeline as cp
from sigstrata.llm import line_dedup, packing, quality_knn, secret_scan, simhash_dedup
from sigstrata.llm.common import table
from sigstrata.session import checkpoint_dir, hadoop_fs
from tests.conftest import SF_SMALL
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secret_scan import plain_all
from tests.llm.test_simhash_dedup import plain_fingerprint, plain_groups


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage over the small table."""
    docs, out = table(spark, SF_SMALL, "documents"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_keeps_what_the_model_accepts(spark, stages):
    before, after = stages[0]
    model = quality_knn.fit(before, table(spark, SF_SMALL, "labels"))
    scores = {r.doc_id: r.score for r in quality_knn.score(before, model).collect()}
    assert set(rows(after)) == {i for i, s in scores.items() if s >= 0.5}
    good = {r.doc_id for r in table(spark, SF_SMALL, "labels").where("quality = 1").collect()} & set(scores)
    assert len(good - set(rows(after))) <= 0.03 * len(good)


def test_lines_equal_brute_force(stages):
    before, after = map(rows, stages[1])
    want = {i: cut for i, (cut, _) in plain_lines([(i, r.text) for i, r in before.items()]).items()}
    assert any(want.values())
    for i, r in before.items():
        left = "\n".join(x for at, x in enumerate(r.text.split("\n")) if at not in want[i])
        if want[i] and not left.strip():
            assert i not in after
        else:
            assert after[i].text == left and after[i].n_chars == (len(left) if want[i] else r.n_chars)


def test_one_of_each_group_stays(stages):
    before, after = map(rows, stages[2])
    roots = plain_groups({i: plain_fingerprint(r.text) for i, r in before.items()})
    assert set(after) == set(roots.values()) and all(after[i] == before[i] for i in after)


def test_secrets_are_cut_and_no_document_goes(stages):
    before, after = map(rows, stages[3])
    model = secret_scan.train(secret_scan.corpus_samples(stages[3][0]))
    assert set(after) == set(before)
    for i, r in before.items():
        out, at = "", 0
        for a, _, b in plain_all(r.text, model):
            if a >= at:
                out += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        out += r.text[at:]
        assert after[i].text == out and after[i].n_chars == (len(out) if out != r.text else r.n_chars)


def test_packing_holds_every_token(spark, stages):
    before, after = stages[4]
    texts = {i: [r.text] for i, r in rows(before).items()}
    check_packing(after.collect(), texts, packing.MAX_TOKENS, packing.TOKEN_BUDGET)
    assert sorted(map(tuple, cp.run(spark, SF_SMALL).select("doc_id", "piece").collect())) == sorted(
        map(tuple, after.select("doc_id", "piece").collect()))


def test_rows_of_one_id_with_unlike_texts_are_apart(spark, docs):
    alpha, beta, gamma, delta = (" ".join(f"{x}{k}" for k in range(40)) for x in ("alpha", "beta", "gamma", "delta"))
    given = docs([(1, alpha), (2, alpha), (2, beta), (3, beta), (4, gamma), (4, delta)])
    kept = sorted((r.doc_id, r.text) for r in cp.near_copies(spark, given, SF_SMALL).collect())
    assert kept == [(1, alpha), (2, beta), (4, delta), (4, gamma)]


def test_edges_through_every_stage(spark, docs):
    secret = "token = x8Fk2pQ9zR4tLm7vBn3wYc6s"
    long = " ".join(f"w{i}" for i in range(30_000))
    given = docs([(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "null id here"), (4, secret), (5, long),
                  (6, long)])
    taken = ["_score", "score", "_ld_id", "deleted_lines", "partners", "_sh_row", "_sc_runs", "rules", "secrets", "_pk_hash", "bucket", "own rules"]
    given = given.selectExpr("*", *[f"'{c}' as `{c}`" for c in taken])
    for at, (name, stage) in enumerate(cp.STAGES):
        assert stage(spark, given.limit(0), SF_SMALL).collect() == []
        out = stage(spark, given, SF_SMALL)
        own = [c for c in taken if at < 4 or c != "bucket"]
        if at < 4:
            assert out.columns == given.columns
        found = out.collect()
        assert found and all(r[c] == c for r in found for c in own)
    assert {r.doc_id for r in cp.lines(spark, given, SF_SMALL).collect()} == {1, 2, 3, None, 4, 5}
    kept = sorted(str(r.doc_id) for r in cp.near_copies(spark, given, SF_SMALL).collect())
    assert kept == ["1", "3", "4", "5", "None"]
    texts = {r.doc_id: r.text for r in cp.secrets(spark, given, SF_SMALL).collect()}
    assert re.fullmatch(r"\[SECRET\]", texts[4]) and texts[1] is None and texts[5] == long
    assert line_dedup.MIN_WORDS == 20 and simhash_dedup.BITS == 64


def test_stage_folders_go_even_if_a_stage_fails(spark, monkeypatch):
    def fails(*_):
        raise ValueError("stage")

    base = checkpoint_dir(spark)
    fs, path = hadoop_fs(spark, base)
    before = {x.getPath().getName() for x in fs.listStatus(path)}
    monkeypatch.setattr(cp, "STAGES", [("first", lambda s, docs, d: docs), ("second", fails)])
    with pytest.raises(ValueError):
        cp.run(spark, SF_SMALL)
    assert not {x.getPath().getName() for x in fs.listStatus(path)} - before
