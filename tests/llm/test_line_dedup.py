from __future__ import annotations

from itertools import combinations
from random import Random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigstrata.llm import line_dedup as ld
from sigstrata.llm.common import pinned, table
from tests.conftest import SF_SMALL


def increasing(values):
    """Length of the longest increasing subsequence, by trying all."""
    return max((n for n in range(len(values) + 1) for c in combinations(values, n)
                if all(a < b for a, b in zip(c, c[1:]))), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_longest_increasing(values):
    at = ld.longest_increasing(values)
    assert at == sorted(set(at)) and len(at) == increasing(values)
    assert all(values[a] < values[b] for a, b in zip(at, at[1:]))


def plain(rows, min_words=20):
    """(id, text) with distinct ids -> id: ({line numbers}, [(partner, its line numbers)]), by looking for equal runs
    of lines of every later document in every earlier one, from every place in both."""
    lines = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        lines[i] = [(x.strip(), at, len(x.split())) for at, x in enumerate(t.split("\n")) if x.strip()]
    out = {}
    for i, own in lines.items():
        cut, shared = set(), []
        for j, other in lines.items():
            if j >= i:
                break
            places, found = {}, set()
            for b, (x, _, _) in enumerate(other):
                places.setdefault(x, []).append(b)
            for a, (x, _, _) in enumerate(own):
                for b in places.get(x, ()):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n][0] == other[b + n][0]:
                        n += 1
                    if sum(w for _, _, w in own[a:a + n]) >= min_words:
                        found.update(at for _, at, _ in own[a:a + n])
            if found:
                cut |= found
                shared.append((j, found))
        out[i] = (cut, shared)
    return out


def agrees(got, want):
    """The same lines go, each with one of the partners named; every partner has a run of lines."""
    assert got.keys() == want.keys()
    for i, (lines, partners) in got.items():
        cut, shared = want[i]
        assert set(lines) == cut and sorted(lines) == lines
        assert set(partners) <= {j for j, _ in shared}
        assert set().union(*[at for j, at in shared if j in partners]) == cut


def result(df):
    return {r.doc_id: (list(r.deleted_lines), list(r.partners)) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = ld.remove_common_blocks(docs), plain(rows)
    assert sum(bool(d) for d, _ in want.values()) > 3
    agrees(result(got), want)
    for r in got.collect():
        lines = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for at, x in enumerate(lines) if at not in want[r.doc_id][0])
    assert got.columns[:5] == docs.columns


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_passages_order_repeats_and_thresholds(docs):
    p, q, s = words(60, "p"), words(30, "q"), words(6, "s")
    rows = [(1, f"{p}\n{q}\n{s}"), (2, f"own line here\n\n  {p} \nother"), (3, f"{q}\n{p}"), (4, f"{s}\nfour"),
            (5, "\n".join([s] * 6)), (6, "\n".join(["x", *[s] * 5])), (7, f"{p}\n{q}\n{s}"), (8, p), (9, words(59, "p"))]
    got = result(ld.remove_common_blocks(docs(rows)))
    agrees(got, plain(rows))
    assert got[2] == ([2], [1]) and got[7] == ([0, 1, 2], [1]) and got[8] == ([0], [1]) and got[3] == ([0, 1], [1])
    assert got[4] == ([], []) and got[9] == ([], []) and got[5] == ([], []) and got[6] == ([1, 2, 3, 4, 5], [5])


def test_a_passage_of_many_documents_is_cut_from_all_but_the_first(docs):
    p = words(55, "p")
    got = result(ld.remove_common_blocks(docs([(i, f"{words(5, f'a{i}x')}\n{p}\n{words(5, f'b{i}x')}") for i in range(60)])))
    assert got == {i: ([1], [0]) if i else ([], []) for i in range(60)}


def test_a_passage_of_short_frequent_lines_is_cut(docs):
    p = "\n".join(words(10, f"p{k}x") for k in range(6))
    got = result(ld.remove_common_blocks(docs([(i, f"{words(5, f'a{i}x')}\n{p}") for i in range(30)])))
    assert got == {i: ([1, 2, 3, 4, 5, 6], [0]) if i else ([], []) for i in range(30)}


def test_edges(docs):
    p = words(25, "p")
    rows = [(None, p), (1, None), (2, ""), (3, "\n \n"), (4, p), (4, p), (4, f"{p}\nend"), (5, "w " * 200_000)]
    df = docs(rows).withColumnRenamed("lang", "partners").withColumnRenamed("source", "line")
    got = sorted(((r.doc_id, r.text[:200] if r.text else r.text, list(r.deleted_lines)) for r in ld.remove_common_blocks(df).collect()), key=str)
    cut = [r for r in got if r[2]]
    assert len(got) == len(rows) and ld.remove_common_blocks(df).columns == ["doc_id", "text", "line", "n_chars", "deleted_lines", "partners"]
    # of the two texts of id 4 the one whose hash is larger is the later; the null id is after both
    assert (None, "", [0]) in cut and len(cut) in (2, 3)
    assert (1, None, []) in got and (3, "\n \n", []) in got
    assert ld.remove_common_blocks(df.limit(0)).collect() == []


def deleted(df):
    return {i: d for i, (d, _) in result(df).items()}


def test_a_block_whose_lines_were_seen_apart_is_cut(docs):
    a, b, c = (words(10, x) for x in "abc")
    five = [words(9, f"l{k}x") for k in range(5)]
    rows = [(1, a), (2, b), (3, c), (4, five[2]), (50, f"x\n{a}\n{b}\n{c}"), (60, f"{a}\n\n{b}\n{c}\ny"), (70, "\n".join(five)), (80, "\n".join(five))]
    got = result(ld.remove_common_blocks(docs(rows)))
    assert got[60] == ([0, 2, 3], [50]) and got[80] == ([0, 1, 2, 3, 4], [70])
    assert not any(d for i, (d, _) in got.items() if i not in (60, 80))


def test_a_passage_in_another_order_than_its_first_holders(docs):
    p, q = words(25, "p"), words(30, "q")
    rows = [(i, f"{p}\nown{i}\n{q}") for i in range(12)] + [(20, f"{q}\n{p}"), (21, f"{q}\nown\n{p}"), (22, f"{q}\n{p}\n{q}")]
    got = result(ld.remove_common_blocks(docs(rows)))
    agrees(got, plain(rows))
    assert got[20] == ([0, 1], [0]) and got[21][0] == [0, 2] and got[22][0] == [0, 1, 2]


@pytest.mark.parametrize("n", [100, 200])
def test_swapped_passages_make_one_pair_per_document(docs, monkeypatch, n):
    made = []
    p, q = words(25, "p"), words(30, "q")
    rows = [(i, f"{p}\nown{i}\n{q}" if i < 8 else f"{q}\nown{i}\n{p}") for i in range(n)]
    monkeypatch.setattr(ld, "pinned", lambda df: made.append(df) or pinned(df))
    got = deleted(ld.remove_common_blocks(docs(rows)))
    assert got == {i: [0, 2] if i else [] for i in range(n)}
    pairs = [df for df in made if df.columns == ["doc", "partner", "lines"]]
    assert len(pairs) == 1 and pairs[0].count() == n - 1


def test_result_is_that_of_all_pairs(docs):
    random = Random(7)
    some = [words(n, f"v{k}x") for k, n in enumerate((4, 7, 9, 10, 11, 13, 21))]
    rows = [(i, "\n".join(random.choice([*some, "", words(3, f"own{i}x")]) for _ in range(random.randint(1, 12)))) for i in range(150)]
    want = plain(rows)
    agrees(result(ld.remove_common_blocks(docs(rows))), want)
    assert sum(bool(cut) for cut, _ in want.values()) > 50


def test_columns_of_any_name_are_kept(docs):
    p = words(25, "p")
    df = docs([(1, p), (2, f"x\n{p}")]).selectExpr("*", "1 as _ld_id", "'k' as _LD_text", "2 as line", "3 as partners", "4 as `kept _ld_id`")
    got = ld.remove_common_blocks(df)
    assert got.columns == [c for c in df.columns if c != "partners"] + ["deleted_lines", "partners"]
    assert sorted((r.doc_id, r.text, r["_ld_id"], r["_LD_text"], r.line, r.partners, r["kept _ld_id"]) for r in got.collect()) == [
        (1, p, 1, "k", 2, [], 4), (2, "x", 1, "k", 2, [1], 4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=12), st.integers(1, 25))
def test_windows_cover_every_run(count, least):
    found = ld.windows(count, least)
    assert len(found) == len(set(found)) <= 2 * len(count) and all(sum(count[a:b + 1]) >= least for a, b in found)
    for a in range(len(count)):
        for b in range(a, len(count)):
            if sum(count[a:b + 1]) >= least:
                assert {x for s, e in found if a <= s and e <= b for x in range(s, e + 1)} == set(range(a, b + 1))


def test_a_line_that_also_stands_elsewhere_does_not_split_a_block(docs):
    x, l1, l2 = (words(10, t) for t in ("x", "l1w", "l2w"))
    rows = [(1, f"{l1}\n{x}\n{l2}"), (2, f"{x}\n{l1}\n{x}\n{l2}"), (11, f"{x}\nown\n{x}\nm {l1}"), (12, f"{x}\nm {l1}")]
    got = deleted(ld.remove_common_blocks(docs(rows)))
    assert got == {1: [], 2: [1, 2, 3], 11: [], 12: [0, 1]}


NOISE = st.lists(st.sampled_from("xy"), max_size=6)


@settings(max_examples=300, deadline=None)
@given(NOISE, NOISE, NOISE, NOISE, st.permutations("abcxyxy"))
def test_a_passage_among_repeated_lines_is_found_whole(left, right, other_left, other_right, passage):
    own, other = [*left, *passage, *right], [*other_left, *passage, *other_right]
    found = ld.common_blocks(own, other, [10] * len(own), 20)
    assert {at for a, b in found for at in range(a, b + 1)} >= set(range(len(left), len(left) + len(passage)))
    joined = ["".join(own[a:b + 1]) for a, b in found]
    assert all(len(x) > 1 and x in "".join(other) for x in joined)
    assert sorted(set(ld.anchors(own, other))) == ld.anchors(own, other)
    assert all(own[a] == other[b] for a, b in ld.anchors(own, other))
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(ld.anchors(own, other), ld.anchors(own, other)[1:]))
