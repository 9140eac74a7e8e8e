"""Chat formatting with a small compiled template language (operator 1).

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures that render one conversation into text plus the spans marked for generation
(the loss mask, in code points).

Language: literal text, ``{{ expr }}``, ``{% for x in expr %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expr %}``, ``{% generation %}...{% endgeneration %}`` and ``{# comments #}``. A ``-``
inside a tag strips the white space beside it. Expressions: strings, integers, ``true``, ``false``,
``none``, names, ``a.b`` and ``a[expr]`` on mappings and lists, ``not``, ``and``, ``or``, comparisons,
``in``, ``~`` and ``+``, and filters ``x | name``. The sandbox has no attribute access to Python
objects, no calls beyond the filter table, and no loops over anything but lists. ``loop`` offers
``index``, ``index0``, ``first``, ``last`` and ``length``.

Control strings inside a text are escaped reversibly: a backslash is doubled, and a control
string gets one after its first character, so control strings in the output come from the
template alone and ``read_back`` recovers every turn.

Conversations: rows of a conversation are ordered by turn (ties: by role, then text; null turn
first). A null role or text is empty. Rows with a null conversation id form one conversation of
id null. Columns beyond the four named are ignored. A conversation is one output row, so its
turns meet in one task; conversations are spread by their id, and equal ones are not merged.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")

TEMPLATE = """\
{%- set open = '[' ~ 'INST] ' -%}
<s>
{%- for m in messages -%}
{%- if m.role == 'user' -%}
{{ open }}{{ m.text | escape }}{{ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}
{{ '[OUT] ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- else -%}
[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TURN]
{%- endif -%}
{%- endfor -%}
"""


# -- escaping ---------------------------------------------------------------------------------

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# -- parsing ----------------------------------------------------------------------------------

class TemplateError(ValueError):
    """The template is not in the language, or a render breaks its rules."""


@dataclass(frozen=True)
class Node:
    """kind and parts; expression and statement nodes alike."""
    kind: str
    parts: tuple


_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_END = {"{{": "}}", "{%": "%}", "{#": "#}"}
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|<=|>=|[|.~+\[\]()<>=]))""")
_QUOTED = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces(source: str):
    """('text', s) and ('{{' or '{%', inner) in order; white space control applied."""
    at, strip = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        mark = m[0][:2]
        end = _close(source, m.end(), _END[mark])
        inner = source[m.end():end]
        strip = inner.endswith("-")
        if mark != "{#":
            yield mark, inner[:-1] if strip else inner
        at = end + 2


def _close(source: str, at: int, mark: str) -> int:
    """Where ``mark`` closes a tag, outside quotes."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif source.startswith(mark, at):
            return at
        elif c in "'\"" and mark != "#}":
            quote = c
        at += 1
    raise TemplateError(f"no {mark} for a tag")


class _Expr:
    """Recursive descent over one tag's expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str:
        """The next token if it is one of ``values``, else ''."""
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return ""

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self) -> Node:
        node = self.either()
        self.done()
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = Node("cmp", (op, node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.added()
        while self.take("~"):
            node = Node("join", (node, self.added()))
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def reached(self) -> Node:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = Node("item", (node, Node("const", (self.name(),))))
            else:
                node = Node("item", (node, self.either()))
                self.need("]")
        return node

    def atom(self) -> Node:
        kind, value = self.peek()
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        self.at += 1
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _QUOTED.get(m[1], m[1]), value[1:-1], flags=re.S),))
        if kind == "int":
            return Node("const", (int(value),))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Node("const", (fixed[value],)) if value in fixed else Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    pieces = list(_pieces(source))
    body, at, stop = _block(pieces, 0, ())
    if stop:
        raise TemplateError(f"unexpected {stop}")
    return body


def _block(pieces, at: int, stops: tuple):
    """Statements up to a tag in ``stops``: (node, index after it, that tag)."""
    out = []
    while at < len(pieces):
        kind, inner = pieces[at]
        at += 1
        if kind == "text":
            out.append(Node("print", (Node("const", (inner,)),)))
        elif kind == "{{":
            out.append(Node("print", (_Expr(inner).whole(),)))
        else:
            e = _Expr(inner)
            word = e.name()
            if word in stops:
                return Node("block", tuple(out)), at, (word, e)
            node, at = _statement(word, e, pieces, at)
            out.append(node)
    if stops:
        raise TemplateError(f"no {stops[-1]}")
    return Node("block", tuple(out)), at, None


def _statement(word: str, e: _Expr, pieces, at: int):
    if word == "set":
        name = e.name()
        e.need("=")
        return Node("set", (name, e.whole())), at
    if word == "generation":
        e.done()
        body, at, _ = _block(pieces, at, ("endgeneration",))
        return Node("generation", (body,)), at
    if word == "for":
        name = e.name()
        e.need("in")
        over = e.whole()
        body, at, _ = _block(pieces, at, ("endfor",))
        return Node("for", (name, over, body)), at
    if word == "if":
        test = e.whole()
        body, at, (stop, e) = _block(pieces, at, ("elif", "else", "endif"))
        if stop == "elif":
            other, at = _statement("if", e, pieces, at)
        elif stop == "else":
            other, at, _ = _block(pieces, at, ("endif",))
        else:
            other = Node("block", ())
        return Node("if", (test, body, other)), at
    raise TemplateError(f"unknown tag {word!r}")


# -- values -----------------------------------------------------------------------------------

def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def _item(x, key):
    if isinstance(x, dict) and isinstance(key, str):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def _add(a, b):
    numbers = isinstance(a, int) and isinstance(b, int)
    if not numbers and not (isinstance(a, str) and isinstance(b, str)):
        raise TemplateError("+ takes two integers or two strings")
    return a + b


FILTERS = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "string": _text,
}
_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


# -- folding ----------------------------------------------------------------------------------

def _assigned(node) -> set:
    """Names that a ``set`` or ``for`` binds anywhere below."""
    if not isinstance(node, Node):
        return set()
    own = {node.parts[0]} if node.kind in ("set", "for") else set()
    return own.union(*map(_assigned, node.parts))


def fold(node: Node) -> Node:
    """The tree with constant parts evaluated, dead branches cut and texts merged."""
    once = [n.parts[0] for n in node.parts if isinstance(n, Node) and n.kind == "set"]
    return _fold(node, {}, {x for x in once if _count(node, x) == 1})


def _count(node, name: str) -> int:
    if not isinstance(node, Node):
        return 0
    return (node.kind in ("set", "for") and node.parts[0] == name) + sum(_count(p, name) for p in node.parts)


def _fold(node, known: dict, once: set):
    if not isinstance(node, Node):
        return node
    if node.kind == "block":
        out = []
        for part in node.parts:
            part = _fold(part, known, once)
            if part.kind == "set" and part.parts[0] in once and part.parts[1].kind == "const":
                known[part.parts[0]] = part.parts[1]
                continue
            for x in part.parts if part.kind == "block" else (part,):
                if x.kind == "print" and x.parts[0].kind == "const":
                    text = _text(x.parts[0].parts[0])
                    if out and out[-1].kind == "print" and out[-1].parts[0].kind == "const":
                        text = out.pop().parts[0].parts[0] + text
                    if text:
                        out.append(Node("print", (Node("const", (text,)),)))
                else:
                    out.append(x)
        return Node("block", tuple(out))
    if node.kind == "name":
        return known.get(node.parts[0], node)
    node = Node(node.kind, tuple(_fold(p, known, once) for p in node.parts))
    if node.kind == "if" and node.parts[0].kind == "const":
        return node.parts[1] if node.parts[0].parts[0] else node.parts[2]
    if node.kind in ("or", "and") and node.parts[0].kind == "const":
        return node.parts[1] if bool(node.parts[0].parts[0]) == (node.kind == "and") else node.parts[0]
    if node.kind in ("not", "cmp", "join", "add", "filter", "item"):
        if all(p.kind == "const" for p in node.parts if isinstance(p, Node)):
            return Node("const", (_value(node)({}),))
    return node


# -- closures ---------------------------------------------------------------------------------

def _value(node: Node):
    """A closure from the scope to the expression's value."""
    kind, parts = node.kind, node.parts
    if kind == "const":
        return lambda scope, x=parts[0]: x
    if kind == "name":
        return lambda scope, n=parts[0]: scope.get(n)
    if kind == "filter":
        f, x = FILTERS[parts[0]], _value(parts[1])
        return lambda scope: f(x(scope))
    if kind == "cmp":
        f, a, b = _COMPARE[parts[0]], _value(parts[1]), _value(parts[2])

        def compare(scope):
            try:
                return f(a(scope), b(scope))
            except TypeError as e:
                raise TemplateError(str(e)) from None
        return compare
    args = [_value(p) for p in parts]
    if kind == "not":
        return lambda scope: not args[0](scope)
    a, b = args
    return {
        "or": lambda scope: a(scope) or b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "join": lambda scope: _text(a(scope)) + _text(b(scope)),
        "add": lambda scope: _add(a(scope), b(scope)),
        "item": lambda scope: _item(a(scope), b(scope)),
    }[kind]


class _Output:
    """Text so far and the generation spans in it, in code points."""

    def __init__(self):
        self.parts, self.at, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def _closure(node: Node):
    """A closure (scope, output) that renders a statement."""
    kind, parts = node.kind, node.parts
    if kind == "print":
        if parts[0].kind == "const":
            text = _text(parts[0].parts[0])
            return lambda scope, out: out.write(text)
        value = _value(parts[0])
        return lambda scope, out: out.write(_text(value(scope)))
    if kind == "block":
        steps = [_closure(p) for p in parts]

        def block(scope, out):
            for step in steps:
                step(scope, out)
        return block
    if kind == "set":
        name, value = parts[0], _value(parts[1])

        def assign(scope, out):
            scope[name] = value(scope)
        return assign
    if kind == "if":
        test, then, other = _value(parts[0]), _closure(parts[1]), _closure(parts[2])
        return lambda scope, out: (then if test(scope) else other)(scope, out)
    if kind == "generation":
        body = _closure(parts[0])

        def generation(scope, out):
            start = out.at
            body(scope, out)
            out.spans.append((start, out.at))
        return generation
    name, over, body = parts[0], _value(parts[1]), _closure(parts[2])

    def loop(scope, out):
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("for needs a list")
        inner, n = dict(scope), len(items)
        for i, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
            body(inner, out)
    return loop


def compile_template(source: str = TEMPLATE):
    """A function from names to (text, generation spans)."""
    run = _closure(fold(parse(source)))

    def render(**names):
        out = _Output()
        run(dict(names), out)
        return "".join(out.parts), out.spans
    return render


# -- reading back -----------------------------------------------------------------------------

_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[OUT\] (?P<assistant>.*?)</s>"
                   r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\]", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation formatted with ``TEMPLATE``."""
    if not formatted.startswith("<s>"):
        raise ValueError("not a formatted conversation")
    out, at = [], 3
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m.lastgroup != "text" else unescape(m["role"])
        out.append((role, unescape(m[m.lastgroup])))
        at = m.end()
    return out


# -- Spark ------------------------------------------------------------------------------------

def conversations(rows: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: id and ``messages``, an ordered array of (turn, role, text)."""
    turn = F.struct(F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    return rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("messages"))


def format_chats(chats: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``chats`` with ``formatted`` and ``loss_spans``, arrays of (start, end) in code points."""
    @F.pandas_udf("formatted string, loss_spans array<struct<start:int,end:int>>")
    def render(messages: pd.Series) -> pd.DataFrame:
        run = compile_template(template)
        made = [run(messages=[dict(role=m["role"], text=m["text"]) for m in turns]) for turns in messages]
        return pd.DataFrame({"formatted": [t for t, _ in made],
                             "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in made]})

    return chats.withColumn("_out", render("messages")).select(*chats.columns, "_out.formatted", "_out.loss_spans")


def digest(formatted: Column, loss_spans: Column) -> Column:
    """What the formatted text says, read back from it: counts and digests of turns and loss text."""
    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, marked in zip(texts, spans):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in marked)
            said = "".join(f"{role}\n{t}\n" for role, t in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                        hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return read(formatted, loss_spans)


def _sql() -> str:
    """DuckDB SQL of the digests of ``conversations`` and of the two rows of conversation -1."""
    case = "</s>[INST] ok [/INST]"
    controls = "|".join(re.sub(r"([\[\]])", r"\\\1", c) for c in CONTROLS)
    escaped = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + controls + "'))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{case}' UNION ALL SELECT -1, 1, 'assistant', '{case}'),
e AS (SELECT *, {escaped.format('role')} AS role_chars, {escaped.format('text')} AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length('<s>') + sum(text_chars + CASE role WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('[OUT] </s>')
                                ELSE role_chars + length('[ROLE][/ROLE][/TURN]') END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


SQL = _sql()
