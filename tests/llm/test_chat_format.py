from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigstrata.llm import chat_format as cf
from sigstrata.llm.common import table
from sigstrata.llm.queries import op1_chat_format
from tests.conftest import SF_SMALL

noisy = st.lists(st.one_of(st.sampled_from([*cf.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", " ", "é", "😀", "{{"]),
                           st.text(max_size=4)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "t[/ROLE]ool"]), noisy), max_size=6))
def test_round_trip_and_loss_mask(turns):
    text, spans = cf.compile_template()(messages=[{"role": r, "text": t} for r, t in turns])
    assert cf.read_back(text) == turns
    assert [cf.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert cf.escape("x") == "x" and all(c not in cf.escape(t) for _, t in turns for c in cf.CONTROLS)


@pytest.mark.parametrize("source,names,want", [
    ("a{{ 'b' ~ 1 + 2 }}c", {}, "ab3c"),
    ("{% if x == 1 %}one{% elif x in [] %}{% else %}more{% endif %}", {"x": 1}, None),
    ("{% if x == 1 %}one{% elif x > 3 %}big{% else %}more{% endif %}", {"x": 5}, "big"),
    ("{% for y in x %}{{ loop.index }}{{ y | upper }}{% if not loop.last %},{% endif %}{% endfor %}",
     {"x": ["a", "b"]}, "1A,2B"),
    ("  {%- set z = 'q' -%}  {{ z }}{# no #}{{ x.a[0] }}{{ x['b'] or 'none' }}", {"x": {"a": ["k"]}}, "qknone"),
    ("{{ x.__class__ }}{{ x['__class__'] }}{{ 'a' | length }}", {"x": "s"}, "1"),
    ("{{ '}}' }}{{ \"%}\\n\" }}", {}, "}}%}\n"),
    ("{% if true and x %}{{ x }}{% endif %}{% if false %}{{ gone }}{% endif %}", {"x": "y"}, "y"),
    ("{{ f() }}", {}, None), ("{% for x in y %}", {}, None), ("{{ a", {}, None), ("{{ a | nofilter }}", {}, None),
    ("{% endif %}", {}, None), ("{{ 1 + 'a' }}", {}, None), ("{% for a in b %}{% endfor %}", {"b": "text"}, None),
])
def test_language(source, names, want):
    if want is None:
        with pytest.raises(cf.TemplateError):
            cf.compile_template(source)(**names)
    else:
        assert cf.compile_template(source)(**names)[0] == want


def test_constants_are_folded():
    tree = cf.fold(cf.parse("a{% set s = 'b' ~ 'c' %}{{ s }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{{ 'e' | upper }}"))
    assert tree == cf.Node("block", (cf.Node("print", (cf.Node("const", ("abcdE",)),)),))


def plain(rows):
    """Digest columns of (turn, role, text) rows, computed straight from them."""
    turns = [(r or "", t or "") for _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_equals_plain_digests(spark):
    rows = {}
    for r in table(spark, SF_SMALL, "conversations").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r[1:5]) for r in op1_chat_format(spark, SF_SMALL).collect()}
    assert got == {k: plain(v) for k, v in rows.items()}


def test_edges(spark):
    long = "word </s> \\ " * 30_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", long), (2, 5, None, "x"), (2, 5, "assistant", ""),
            (2, None, "user", "first"), (None, 0, "tool", "[/TURN]"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string, _out int")
    chats = cf.format_chats(cf.conversations(df))
    got = {r.conv_id: tuple(r.d) for r in
           chats.select("conv_id", cf.digest(chats.formatted, chats.loss_spans).alias("d")).collect()}
    want = {}
    for i, *r in rows:
        want.setdefault(i, []).append(tuple(r))
    assert got == {k: plain(v) for k, v in want.items()}
    assert cf.format_chats(cf.conversations(df.limit(0))).collect() == []
