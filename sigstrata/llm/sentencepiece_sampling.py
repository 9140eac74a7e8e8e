"""SentencePiece encoding by forward filtering and backward sampling, and decoding (operator 2).

All segmentations of a text into pieces form a lattice over its characters. Forward filtering
sums, for every position, the weights of all ways to reach it; backward sampling walks from the
end and draws each piece in proportion to its share of that sum, which draws a whole
segmentation exactly in proportion to its weight. A piece weighs ``exp(alpha * log p)``, so a
large ``alpha`` approaches the best segmentation and 0 is uniform over segmentations. The random
number of a position is a hash of the row's key, the seed and the position: a row is segmented
alike wherever and whenever it runs.

``log p``: a unigram model's scores are log probabilities; a byte-pair model's are minus the
merge rank, from which ``zipf`` takes ``-log(1 + rank)``.

As in SentencePiece, spaces belong to the pieces, a space is put before the text, and characters
that no piece has become byte pieces; so does a literal lower-one-eighth block, the mark that stands for a
space in the vocabulary file. Decoding gives back every text exactly.

No piece of the vocabularies has a space after another character, so the lattice falls apart at
spaces (checked when a vocabulary is read; otherwise whole texts are one lattice). The distinct
words of a block of rows are filtered together, and all its words are drawn together.

Edge cases: null and empty texts have no pieces; decoding no pieces gives the empty text. A null
key draws like the key ``None``. Rows with equal keys and texts get equal pieces. Very long texts
and words are lattices of linear size. An empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.6
BYTE_LOG_P = -12.0
BLOCK_CHARS = 500_000
SHARE_BITS = 32
RESCALE = 8         # positions of a word between two rescalings
LIFT = 2.5          # about what a character costs in a segmentation
_NONE = np.int32(-(1 << 31))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Vocabulary:
    """Pieces with their ids and log probabilities, spaces written as spaces."""

    def __init__(self, model: bytes, scores: str = "zipf"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text: dict[int, str] = {}
        self.byte_id: dict[int, int] = {}
        self.log_p: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece, score = piece.replace("▁", " "), sp.get_score(i)
                self.text[i], self.id[piece] = piece, i
                self.log_p[piece] = -math.log(1 - score) if scores == "zipf" else score
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.id))
        split = all(" " not in p.lstrip(" ") for p in self.id)
        self.chunks = re.compile(f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else "") if split else "(?s).+")

    @cached_property
    def trie(self) -> "Trie":
        return Trie(self.id, self.log_p)

    def decode(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(self.text[i])
        out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


def uniform(seeds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SHARE_BITS`` random bits for each seed and position (splitmix64)."""
    x = seeds + at.astype(np.uint64) * _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - SHARE_BITS)).astype(np.int64)


class Trie:
    """The pieces' prefixes as states, stepped for many positions at once.

    Steps (state, character) -> state are kept in an open-addressed hash table of flat arrays.
    """

    def __init__(self, ids: dict[str, int], log_p: dict[str, float]):
        state, steps = {"": 0}, {}
        for piece in ids:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in state:
                    state[piece[:n]] = len(state)
                    steps[state[piece[:n - 1]] << 21 | ord(piece[n - 1])] = state[piece[:n]]
        self.piece = np.full(len(state), -1, np.int32)
        self.log_p = np.zeros(max(ids.values(), default=0) + 1)     # by id
        self.depth = max(map(len, ids), default=1)
        for piece, i in ids.items():
            self.piece[state[piece]], self.log_p[i] = i, log_p[piece]
        bits = max(4, (4 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, to in steps.items():
            at = (key * int(_GOLDEN) & (1 << 64) - 1) >> int(self.shift)
            while self.key[at] >= 0:
                at = at + 1 & self.mask
            self.key[at], self.to[at] = key, to

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, -1 where no piece goes on."""
        key = states.astype(np.int64) << 21 | codes
        at = ((key.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)
        held = self.key[at]
        out = np.where(held == key, self.to[at], -1)
        odd = np.nonzero((held != key) & (held >= 0))[0]        # the slot holds another step: look on
        while len(odd):
            at[odd] = at[odd] + 1 & self.mask
            held = self.key[at[odd]]
            same = held == key[odd]
            out[odd[same]] = self.to[at[odd[same]]]
            odd = odd[~same & (held >= 0)]
        return out


class Lattices:
    """Forward-filtered lattices of some words, as flat arrays of nodes and incoming edges.

    Node ``first[w] + k`` is the position after ``k`` characters of word ``w``. Edges are in the
    order of their end nodes, those of node ``k`` from ``begin[k]`` on; ``cum`` is the share of its
    edges up to this one, in units of ``2 ** -SHARE_BITS``: whole numbers.
    """

    def __init__(self, v: Vocabulary, words: list[str], alpha: float):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.last = self.first + size
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        nodes = int(self.last[-1]) + 1
        self.span, self.alpha = v.trie.depth, alpha
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        node = np.arange(len(codes), dtype=np.int32) + word         # the position before each character
        left = (self.last.astype(np.int32))[word] - node            # characters to the word's end
        trie = v.trie
        # the token of each length that ends at each node
        tokens = np.full((nodes, trie.depth), _NONE, np.int32)
        start, state = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32)
        for n in range(1, trie.depth + 1):
            state = trie.step(state, codes[start + (n - 1)])
            going = np.flatnonzero(state >= 0)
            start, state = start[going], state[going]
            piece = trie.piece[state]
            found = np.flatnonzero(piece >= 0)
            tokens[node[start[found]] + n, n - 1] = piece[found]
            if n == 1:      # characters that only bytes can say
                alone = np.ones(len(codes), bool)
                alone[start[found]] = False
                alone = np.flatnonzero(alone)
                tokens[node[alone] + 1, 0] = -1 - codes[alone]
            going = np.flatnonzero(left[start] > n)
            start, state = start[going], state[going]
        end, length = np.nonzero(tokens != _NONE)
        self.token = tokens[end, length]
        del tokens
        self.length = length.astype(np.int32) + 1
        self.back = end.astype(np.int32) - self.length
        log_p = trie.log_p[np.maximum(self.token, 0)]
        odd = np.flatnonzero(self.token < 0)
        code = -1 - self.token[odd]
        log_p[odd] = BYTE_LOG_P * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        self.begin = np.searchsorted(end, np.arange(nodes + 1)).astype(np.int32)
        self.cum = self._filter(end, alpha * log_p, size)

    def _filter(self, end: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum the ways to each node, one position of all words after the other.

        Sums are scaled by a constant for each character, and every few positions by a word's own
        sum, which leaves the shares alone and keeps them from running out of range.
        """
        logs = self.alpha > 1       # steep weights: in logarithms
        if not logs:
            weight = np.exp(weight + LIFT * self.alpha * self.length)
        nodes = len(self.begin) - 1
        reach, share = np.zeros(nodes), np.empty(len(end))
        reach[self.first] = 0 if logs else 1
        longest = int(size.max(initial=0))
        by_size = np.argsort(size, kind="stable")
        from_size = np.searchsorted(size[by_size], np.arange(longest + 2))
        for k in range(1, longest + 1):
            at = np.sort(self.first[by_size[from_size[k]:]]) + k        # of the words this long
            low = self.begin[at]
            count = self.begin[at + 1] - low
            base = np.cumsum(count) - count
            edges = np.repeat(low - base, count) + np.arange(int(count.sum()))
            if logs:
                ways = reach[self.back[edges]] + weight[edges]
                top = np.maximum.reduceat(ways, base)
                ways = np.exp(ways - np.repeat(top, count))
            else:
                ways = reach[self.back[edges]] * weight[edges]
            total = np.add.reduceat(ways, base)
            reach[at] = top + np.log(total) if logs else total
            share[edges] = ways / np.repeat(total, count)
            if not logs and k % RESCALE == 0:       # the positions that pieces can still reach back to
                back = at[:, None] - np.arange(min(k, self.span) + 1)
                reach[back] /= total[:, None]
        part = (share * (1 << SHARE_BITS)).astype(np.int64)
        cum = np.cumsum(part)
        begin = self.begin[:-1]
        has = self.begin[1:] > begin
        before = np.zeros(nodes, np.int64)
        before[has] = cum[begin[has]] - part[begin[has]]
        cum -= before[end]
        cum[self.begin[1:][has] - 1] = 1 << SHARE_BITS
        return cum

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The incoming edge of each node at ``u``."""
        edge = self.begin[node].astype(np.int64)
        more = np.flatnonzero(self.cum[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[self.cum[edge[more]] <= u[more]]
        return edge


class Sampler:
    def __init__(self, vocabulary: Vocabulary, alpha: float = ALPHA, seed: int = 0):
        self.v, self.alpha, self.seed = vocabulary, alpha, seed

    def block(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """Sampled ids of each text."""
        number: dict[str, int] = defaultdict(lambda: len(number))
        chunks, counts = [], []
        for text in texts:
            found = self.v.chunks.findall(" " + text) if text else []
            chunks += [number[c] for c in found]
            counts.append(len(found))
        if not chunks:
            return [np.zeros(0, np.int32) for _ in texts]
        lat = Lattices(self.v, list(number), self.alpha)
        chunk = np.array(chunks, np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(str(k), self.seed) for k in keys], np.uint64)
        row = np.repeat(np.arange(len(texts)), counts)
        base = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])     # of each row in the block
        first, node = lat.first[chunk], lat.last[chunk]
        at = np.cumsum(node - first) - base[row]            # the chunk's end within its row
        drawn = np.full(int(base[-1]) + 1, _NONE, np.int32)      # by the place where a token ends
        while len(node):
            edge = lat.draw(node, uniform(seeds[row], at))
            drawn[base[row] + at] = lat.token[edge]
            at, node = at - lat.length[edge], lat.back[edge]
            going = np.flatnonzero(node > first)
            node, at, first, row = node[going], at[going], first[going], row[going]
        ends = np.flatnonzero(drawn != _NONE)
        tokens, bounds = drawn[ends], np.searchsorted(ends, base, side="right")
        return [self._bytes(tokens[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _bytes(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens below 0 written as the byte pieces of their character."""
        odd = np.nonzero(tokens < 0)[0]
        if not len(odd):
            return tokens
        parts, last = [], 0
        for i in odd.tolist():
            raw = chr(-1 - int(tokens[i])).encode("utf-8", "surrogatepass")
            parts += [tokens[last:i], np.array([self.v.byte_id[b] for b in raw], np.int32)]
            last = i + 1
        return np.concatenate([*parts, tokens[last:]])

    def rows(self, keys: list, texts: list[str]) -> Iterator[np.ndarray]:
        """Like ``block``, in blocks of bounded size."""
        for a, b in blocks(list(map(len, texts))):
            yield from self.block(keys[a:b], texts[a:b])


def blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK_CHARS`` characters."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size > BLOCK_CHARS or i == len(sizes) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: bytes | None = None,
           alpha: float = ALPHA, seed: int = 0, scores: str = "zipf", out: str = "ids",
           check: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with an array of sampled piece ids, seeded by ``key_col``; ``check`` names a column
    that says whether decoding them gave the text back; ``keep`` names the columns to carry along.

    Rows come and go as Arrow batches; a batch goes out in blocks, so that the pieces of many rows
    are never held at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model() if model is None else model)
    made = [out] + [check] * bool(check)
    named = [c for c in (docs.columns if keep is None else keep) if c not in made]
    # columns go by number, so that none is taken for another
    kept = [f"c{k}" for k in range(len(named))]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in named] + [T.StructField(out, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(check, T.BooleanType())] if check else []))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Vocabulary(shared.value, scores), alpha, seed)
        for batch in batches:
            for a, b in blocks(pc.utf8_length(batch.column("text")).to_pylist()):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                ids = sampler.block(part.column("key").to_pylist(), texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [part.column(c) for c in kept] + [pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))]
                if check:
                    columns.append(pa.array([sampler.v.decode(x.tolist()) == t for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=named + made)

    key = F.coalesce(F.col(key_col).cast("string"), F.lit("None"))
    read = docs.select(*[F.col(c).alias(k) for c, k in zip(named, kept)], key.alias("key"), text_of(text_col).alias("text"))
    return read.mapInArrow(sample, schema)


def decode(docs: DataFrame, ids_col: str = "ids", model: bytes | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of piece ids (null ids: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model() if model is None else model)

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(shared.value)
        for ids in batches:
            yield pd.Series([vocabulary.decode(x.tolist()) if x is not None else "" for x in ids], dtype=object)

    return docs.withColumn(out, join(F.col(ids_col)))
