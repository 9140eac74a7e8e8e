"""Main text of web pages by a conditional random field over leaf blocks (operator 11).

* Leaf blocks: a page is read as tags and text in one pass. A block is the text between two borders of
  block-level elements, with the elements that it is in. Left-out end tags are implied (``p``, ``li``, table cells), end
  tags without an element are passed over, and scripts, styles and other unseen elements hold no blocks.
  Character references are decoded, white space (``br`` included) becomes one space.
* Features of a block: the tags of its ancestors and the words of their ``class``, ``id`` and ``role``; its own
  tag, length, share of linked text, punctuation, digits, capitals and marks; words that stand in menus and
  notices; its place in the page. Features that the labelled pages do not show often enough have no weight.
* A linear-chain conditional random field labels the blocks of a page as main text or not: block weights, and
  weights of label pairs that depend on whether two neighbours have one parent. It is trained here, by the gradient of
  the penalised likelihood (forward-backward), on labelled pages: pairs of html and main text. A block is labelled main
  text if its text is a line of the page's main text.
* Viterbi decoding in the tasks; the model is a few hundred weights and goes with the function.

``labelled_pages`` writes the labelled pages that the query learns from: ``LABELLED`` pages of many layouts, with
and without semantic tags, in words made up on the spot. Other labelled pages can be given to ``train``.

Edge cases: null html is empty, and an empty page has an empty text. A page without markup is one block. Pages are
independent: repeated ids and rows stay as they are. Extra columns are kept; columns named like a result
column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LABELLED = 1000         # pages that ``labelled_pages`` writes
LEAST = 4               # blocks that must show a feature
PENALTY = 0.5
ROUNDS = 200

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
                   r"""|([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("canvas datalist head noscript object svg template".split())
IN_HEAD = RAW | frozenset("base link meta noscript template".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul""".split())
SECTION = frozenset("article aside dialog footer form header main nav".split())
#: Start tag -> the open elements it ends, up to one of the elements that hold them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
IN_P = frozenset("button label legend option optgroup".split())     # block elements that a paragraph may hold
NONE: frozenset = frozenset()


class Page:
    """Reads a page's leaf blocks.

    ``weigh(tag, attributes)`` gives the features that an element adds to all that is in it, and its names; of
    these, those of the nearest element that has any count. So do kinds of sections, with the kind around them.
    """

    def __init__(self, source: str, weigh):
        self.blocks: list[tuple] = []       # (text, features of the ancestors, own tag, parent, linked characters)
        self._weigh = weigh
        # (tag, number, all features, those of it and its ancestors, nearest section, nearest names)
        self._stack: list[tuple] = [("", 0, NONE, NONE, "", NONE)]
        self._run: list[str] = []
        self._linked, self._links, self._unseen, self._count = 0, 0, 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            token = TOKEN.search(source, at)
            stop = token.start() if token else end
            if stop > at and not self._unseen:
                self._text(source[at:stop])
            if not token:
                break
            at = token.end()
            if token[2]:
                tag = token[2].lower()
                self._start(tag, token[3])
                if tag in RAW:
                    close = _closing(tag).search(source, at)
                    at = close.end() if close else end
            elif token[1]:
                self._end(token[1].lower())
        self._flush()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._links:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                at = len(self._stack) - 1
                while at and self._stack[at][0] not in BLOCK:
                    at -= 1
                tag, _, features, *_ = self._stack[at]
                self.blocks.append((text, features, tag, self._stack[max(0, at - 1)][1], self._linked))
            self._run = []
        self._linked = 0

    def _pop(self, size: int) -> None:
        for tag, *_ in self._stack[size:]:
            self._links -= tag == "a"
            self._unseen -= tag in UNSEEN
        del self._stack[size:]

    def _start(self, tag: str, attributes: str) -> None:
        if self._stack[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self._stack) - 1)
        if tag in BLOCK:
            self._flush()
            if tag not in IN_P:
                self._close({"p"}, {"button", "td", "th", "table", "object"})
            if tag in ENDS:
                self._close(*ENDS[tag])
            if tag == "body":
                self._pop(1 + (len(self._stack) > 1 and self._stack[1][0] == "html"))
        elif tag == "br":
            self._run.append(" ")
        if tag in VOID or tag in RAW:
            return
        if tag == "a":
            self._remove("a")
            self._links += 1
        self._unseen += tag in UNSEEN
        self._count += 1
        _, _, both, above, section, names = self._stack[-1]
        own, own_names = self._weigh(tag, attributes)
        if own_names or tag in SECTION or not own <= above:
            above, names = above | own, own_names or names
            if tag in SECTION:
                section = f"{section.rpartition(' ')[2]} {tag}"
            both = above | names | {f"nearest {section}", f"nearest {section.rpartition(' ')[2]}"}
        self._stack.append((tag, self._count, both, above, section, names))

    def _close(self, ends, within) -> None:
        """End the open elements of ``ends`` that are not in an element of ``within``."""
        size = len(self._stack)
        for at in range(size - 1, 0, -1):
            tag = self._stack[at][0]
            if tag in within:
                break
            if tag in ends:
                size = at
            elif tag in BLOCK and "p" in ends:
                break
        self._pop(size)

    def _remove(self, tag: str) -> None:
        """End an inline element; those in it stay open."""
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at][0] == tag:
                self._links -= tag == "a"
                del self._stack[at]
                return
            if self._stack[at][0] in BLOCK:
                return

    def _end(self, tag: str) -> None:
        if tag not in BLOCK and tag not in UNSEEN:
            self._remove(tag)
            return
        if tag in BLOCK:
            self._flush()
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at][0] == tag:
                self._pop(at)
                return
            if self._stack[at][0] in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "body", "html"):
                return


@lru_cache(maxsize=None)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def element_features(tag: str, attributes: str) -> tuple[frozenset, frozenset]:
    """The tag and the words of ``class``, ``id`` and ``role``; the words as the nearest names."""
    out, names = {f"in {tag}"}, set()
    if "=" in attributes:
        for _, *values in ATTRIBUTE.findall(attributes):
            names.update(w.lower() for value in values for w in NAME_WORD.findall(value)[:20])
    if "hid" in attributes or "none" in attributes:
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)|display:\s*none", attributes):
            out.add("unseen")
    return frozenset(out | {f"named {w}" for w in names}), frozenset(f"nearest name {w}" for w in names)


#: Fixed: word beginnings of menus, notices, forms, adverts and comments in the languages of the tables.
SPEECH = tuple("""abonn accept advert akzept all anmeld annonc anunci anzeige antwort aviso buscar comment condition connect consent
contact cookie copyright dark datenschutz derechos droits follow folg home impressum inicio iniciar inscri kommentar konto kontakt
legal licen log login menu menü mention next newsletter partag politi polí previous privacy recherch registr reply rechte répond
reserv respond related read rights rss search share sign sitemap skip startseite subscrib such suscri teilen terms tweet weiter
werbung wrote zugriff""".split())
BEGINNINGS = {w[:3] for w in SPEECH}
DIGIT, CAPITAL = re.compile(r"\d"), re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")


def text_features(text: str, tag: str, linked: int) -> list[str]:
    """What a block's own text shows."""
    words, size = text.count(" ") + 1, len(text)
    head = text[:200]
    out = [f"tag {tag}", f"words {bisect((2, 3, 5, 9, 16, 31, 61), words)}", f"links {bisect((0.01, 0.3, 0.6, 0.95), linked / size)}",
           f"commas {bisect((1, 3, 8), text.count(','))}", f"digits {bisect((0.01, 0.1, 0.4), len(DIGIT.findall(head)) / len(head))}",
           f"capitals {bisect((0.01, 0.05, 0.2, 0.6), len(CAPITAL.findall(head)) / len(head))}",
           "stop" if text[-1] in ".!?…:;\"'»”)" else "no stop"]
    if words <= 30:
        said = {w for x in head.lower().split() if x[:3] in BEGINNINGS for w in SPEECH if x.startswith(w)}
        if said:
            out += ["says any", *(f"says {w}" for w in sorted(said))]
        out += [f"mark {c}" for c in "©@|»›→·#%" if c in head]
    return out


def place_features(at: int, n: int, heading: bool) -> list[str]:
    return [f"place {min(3, at)}", f"left {min(3, n - 1 - at)}", "below a heading" if heading else "above all headings"]


@dataclass
class Model:
    weights: dict           # feature -> weight of main text
    pairs: np.ndarray       # kind of neighbours x label x label

    def reader(self) -> "Reader":
        return Reader(self)

    def text(self, source: str | None) -> str:
        return self.reader().text(source)


class Reader:
    """Decodes pages; keeps the weights of the elements met so far."""

    def __init__(self, model: Model):
        self.weight, self.pairs = model.weights.get, model.pairs.tolist()
        self._known = model.weights.keys()
        self._elements: dict = {}
        self._above: dict = {}

    def weigh(self, tag: str, attributes: str) -> tuple:
        found = self._elements.get((tag, attributes))
        if found is None:
            if len(self._elements) >= 50_000:
                self._elements.clear()
            found = tuple(frozenset(f for f in part if f in self._known) for part in element_features(tag, attributes))
            self._elements[tag, attributes] = found
        return found

    def _sum(self, features: frozenset) -> float:
        found = self._above.get(features)
        if found is None:
            if len(self._above) >= 50_000:
                self._above.clear()
            found = self._above[features] = sum(self.weight(f, 0.0) for f in sorted(features))
        return found

    def labels(self, blocks: list[tuple]) -> list[bool]:
        """Most likely labels of a page's blocks (Viterbi)."""
        weight, n, pairs = self.weight, len(blocks), self.pairs
        off, on, back, heading, parent = 0.0, 0.0, [], False, None
        for at, (text, above, tag, owner, linked) in enumerate(blocks):
            own = self._sum(above)
            for f in text_features(text, tag, linked):
                own += weight(f, 0.0)
            for f in place_features(at, n, heading):
                own += weight(f, 0.0)
            heading = heading or tag == "h1"
            if at:
                (a, b), (c, d) = pairs[owner == parent]
                to_off, to_on = on + c > off + a, on + d > off + b
                off, on = (on + c if to_off else off + a), (on + d if to_on else off + b)
                back.append((to_off, to_on))
            on += own
            parent = owner
        out = [on > off] if n else []
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def text(self, source: str | None) -> str:
        blocks = Page(source or "", self.weigh).blocks
        return "\n".join(b[0] for b, keep in zip(blocks, self.labels(blocks)) if keep)


def page_features(source: str) -> tuple[list[list[str]], list[int], list[str]]:
    """Of a page's blocks: features, whether the parent is that of the block before, texts."""
    blocks, heading, out, kinds = Page(source, element_features).blocks, False, [], []
    for at, (text, above, tag, owner, linked) in enumerate(blocks):
        out.append([*above, *text_features(text, tag, linked), *place_features(at, len(blocks), heading)])
        kinds.append(bool(at) and owner == blocks[at - 1][3])
        heading = heading or tag == "h1"
    return out, kinds, [b[0] for b in blocks]


def train(labelled: list[tuple[str, str]], least: int = LEAST, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Fit the weights to pairs of html and main text, by Adam on the whole penalised likelihood."""
    pages = [(*page_features(source), set(text.split("\n"))) for source, text in labelled]
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))        # the longest first
    count: dict[str, int] = {}
    for blocks, *_ in pages:
        for found in blocks:
            for f in found:
                count[f] = count.get(f, 0) + 1
    names = sorted(f for f, k in count.items() if k >= least)
    if not names:
        return Model({}, np.zeros((2, 2, 2)))
    number = {f: k for k, f in enumerate(names)}
    n, longest = len(pages), len(pages[0][0])
    size = np.array([len(p[0]) for p in pages])
    having = [int((size > t).sum()) for t in range(longest)]        # pages with a block at t are the first ones
    same, truth = np.zeros((n, longest), np.int64), np.zeros((n, longest), np.int64)
    cell, feature = [], []
    for i, (blocks, kinds, texts, main) in enumerate(pages):
        for t, found in enumerate(blocks):
            same[i, t], truth[i, t] = kinds[t], texts[t] in main
            known = [number[f] for f in found if f in number]
            cell += [i * longest + t] * len(known)
            feature += known
    cell, feature = np.array(cell, np.int64), np.array(feature, np.int64)
    real = np.arange(longest) < size[:, None]
    linked = real[:, 1:]
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
    moments = [[np.zeros_like(weights), np.zeros_like(pairs)] for _ in range(2)]
    for k in range(1, rounds + 1):
        score = np.bincount(cell, weights[feature], n * longest).reshape(n, longest)
        unary = np.stack([np.zeros_like(score), score], axis=2)
        edge = pairs[same]
        forward, backward = unary.copy(), np.zeros((n, longest, 2))
        for t in range(1, longest):
            m = having[t]
            forward[:m, t] += np.logaddexp(forward[:m, t - 1, None, 0] + edge[:m, t, 0], forward[:m, t - 1, None, 1] + edge[:m, t, 1])
        for t in range(longest - 2, -1, -1):
            m = having[t + 1]
            after = unary[:m, t + 1] + backward[:m, t + 1]
            backward[:m, t] = np.logaddexp(edge[:m, t + 1, :, 0] + after[:, None, 0], edge[:m, t + 1, :, 1] + after[:, None, 1])
        whole = np.logaddexp(*forward[np.arange(n), size - 1].T)
        on = np.where(real, np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - whole[:, None])), 0)
        both = np.exp(np.minimum(0, forward[:, :-1, :, None] + edge[:, 1:] + (unary + backward)[:, 1:, None, :]
                                 - whole[:, None, None, None])) * linked[:, :, None, None]
        slopes = [np.bincount(feature, (on - truth * real).ravel()[cell], len(names)) + penalty * weights, penalty * pairs]
        for x in (0, 1):
            chosen = linked & (same[:, 1:] == x)
            slopes[1][x] += both[chosen].sum(axis=0)
            np.subtract.at(slopes[1][x], (truth[:, :-1][chosen], truth[:, 1:][chosen]), 1.0)
        for value, slope, x in zip((weights, pairs), slopes, (0, 1)):
            moments[0][x] = 0.9 * moments[0][x] + 0.1 * slope
            moments[1][x] = 0.99 * moments[1][x] + 0.01 * slope * slope
            value -= 0.1 * (moments[0][x] / (1 - 0.9 ** k)) / (np.sqrt(moments[1][x] / (1 - 0.99 ** k)) + 1e-8)
    return Model({f: float(w) for f, w in zip(names, weights)}, pairs)


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with the main ``text`` and its ``n_chars``."""
    model = labelled_model() if model is None else model

    @F.pandas_udf("string")
    def main_text(sources: pd.Series) -> pd.Series:
        read = model.reader().text
        return pd.Series([read(x) for x in sources], dtype=object)

    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    found = pages.select(*rest, main_text(text_of(html_col)).alias("text"))
    return found.select(*rest, "text", F.length("text").cast("long").alias("n_chars"))


@lru_cache(maxsize=2)
def labelled_model(pages: int = LABELLED, seed: int = 0) -> Model:
    from .labelled_pages import labelled_pages
    return train(labelled_pages(pages, seed))
