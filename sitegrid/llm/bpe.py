"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled one after another. Each merge (u, v) -> w is a gadget on the automaton over tokens: every
path u v gets an arc w, and the state that u leads to is split so that v can't follow any more. A state is thus known by
the token that leads to it, and whether it has an arc t depends on the gadgets only: along the right edge of the one
token's merge tree and the left edge of the other's, no gadget may have been applied while both of its parts still
stood there. Exactly one path spells any byte string, and it is the string's BPE encoding.

Arcs spell several bytes, so reading bytes is made deterministic by the subset construction: a state of the byte automaton
holds the arcs that are under way, each with the token before it, and the one token that ends here on an accepted path. A
table of transitions, filled when first used and bounded in size, takes one step a byte and never back; the arcs of the
path are then read off from the last one, each of which names the place where the one before it ended. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from sitegrid.llm.common import arrow_map, pieces

#: The byte-level pre-splitting; white space is Unicode's, as in the library.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of code points under 256, in the standard library's faster engine.
LETTERS = "".join(chr(c) for c in range(256) if regex.match(r"\p{L}", chr(c)))
NUMBERS = "".join(chr(c) for c in range(256) if regex.match(r"\p{N}", chr(c)))
SPACES = "\t-\r \x85\xa0"
PLAIN = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Code points that Unicode versions disagree on; the library itself splits texts that hold them.
UNSURE = None
NEVER = 1 << 60
CACHE = 300_000
#: Transitions that are kept, at most, before a word.
TABLE = 400_000


def unsure() -> re.Pattern:
    global UNSURE
    if UNSURE is None:
        open_ = [c for c in range(256, 0xE0000) if unicodedata.category(chr(c)) == "Cn"]
        ends = [i for i, c in enumerate(open_) if i + 1 == len(open_) or open_[i + 1] != c + 1]
        spans = [(open_[a + 1], open_[b]) for a, b in zip([-1, *ends[:-1]], ends, strict=True)]
        UNSURE = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "\\U000e0000-\\U0010ffff]")
    return UNSURE


def split(text: str) -> list[str]:
    """text in pre-split words."""
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        if unsure().search(text):
            return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
        return SPLIT.findall(text)
    return PLAIN.findall(text)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for i, b in enumerate(b for b in range(256) if b not in set(keep)):
        out[chr(256 + i)] = b
    return out


class Recent(dict):
    """A bounded cache of make(word) in two generations: words in use outlive the rest."""

    def __init__(self, make, most: int = CACHE) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word):
        if (out := self.old.get(word)) is None:
            out = self.make(word)
            if len(word) > 64:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class Automaton:
    """Compiled merges. encode(bytes) gives token ids, labels[id] the bytes of an arc."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]) -> None:
        self.special = special
        self.labels = _labels(vocab, special)
        size = len(self.labels)
        self.gadgets: dict[int, int] = {}
        self.size = size
        self.heads: dict[int, list] = {}
        self.tails: dict[int, list] = {}
        self.birth, self.left, self.right = (array("i", [-1]) * size for _ in range(3))
        for rank, pair in enumerate(merges):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            self.gadgets.setdefault(a * size + b, rank)
            if self.birth[w] < 0:
                self.birth[w], self.left[w], self.right[w] = rank, a, b
        # the labels of all arcs, as a tree of bytes
        self.child: dict[int, int] = {}
        self.token, self.more = array("i", [-1]), bytearray(1)
        for i in vocab.values():
            label, node = self.labels[i], 0
            if len(label) > 1 and self.birth[i] < 0:
                continue
            for c in label:
                self.more[node] = 1
                if (to := self.child.get(node << 8 | c)) is None:
                    to = self.child[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.more.append(0)
                node = to
            self.token[node] = i
        self._reset()
        self.ids = Recent(lambda word: np.array(self.encode(word.encode()), np.int32).tobytes())

    def _reset(self) -> None:
        """The byte automaton with its first state only."""
        self.steps: dict[int, int] = {}
        self.inside: list[tuple] = [(0, -1)]
        self.ends = array("i", [-1])
        self.number = {(0, -1): 0}

    def _edge(self, t: int, side: array) -> list[tuple[int, int]]:
        """The tokens along one edge of t's merge tree, each with the time until which it stood there."""
        out, until = [], NEVER
        while t >= 0:
            out.append((t, until))
            until, t = self.birth[t], side[t]
        return out

    def follows(self, x: int, t: int) -> bool:
        """Whether the state that x leads to has an arc t."""
        if (heads := self.heads.get(t)) is None:
            heads = self.heads[t] = self._edge(t, self.left)
        if (tails := self.tails.get(x)) is None:
            tails = self.tails[x] = [(u * self.size, end) for u, end in self._edge(x, self.right)]
        get = self.gadgets.get
        for u, end in tails:
            for v, stop in heads:
                if (at := get(u + v)) is not None and at < end and (at < stop or at == stop and u == v * self.size):
                    return False
        return True

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte, a new one if need be, now in the table."""
        under_way, last, inside = [], -1, self.inside[state]
        child, token, more = self.child.get, self.token, self.more
        pairs = iter(inside)
        for node, before in zip(pairs, pairs, strict=True):
            if (to := child(node << 8 | byte)) is not None:
                if last < 0 and (t := token[to]) >= 0 and (before < 0 or self.follows(before, t)):
                    last = t
                if more[to]:
                    under_way += to, before
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (*under_way, 0, last)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.inside)
            self.inside.append(key)
            self.ends.append(last)
        self.steps[state << 8 | byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """The one accepted path that spells word: a transition a byte, then the path's arcs from the last one."""
        if len(self.steps) > TABLE:
            self._reset()
        steps, state, path = self.steps, 0, []
        for c in word:
            try:
                state = steps[state << 8 | c]
            except KeyError:
                state = self.step(state, c)
            path.append(state)
        out, at, labels, ends = [], len(word), self.labels, self.ends
        while at:
            t = ends[path[at - 1]]
            out.append(t)
            at -= len(labels[t])
        return out[::-1]

    def encode_text(self, text: str) -> np.ndarray:
        parts = [text]
        if any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                out += map(self.ids.__getitem__, split(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        return spelled(self.labels, ids)


def spelled(labels: list[bytes], ids) -> str:
    """The text of the arcs' labels."""
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def _labels(vocab: dict[str, int], special: dict[str, int]) -> list[bytes]:
    of = byte_chars()
    out = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
    for t, i in vocab.items():
        out[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
    for t, i in special.items():
        out[i] = t.encode()
    return out


def _parts(path: str) -> tuple[dict, list, dict]:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    return j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j["added_tokens"]}


@lru_cache(1)
def load(path: str) -> Automaton:
    parts = _parts(path)
    gc.collect()
    gc.freeze()
    return Automaton(*parts)


@lru_cache(2)
def load_labels(path: str) -> list[bytes]:
    """All that decoding needs."""
    vocab, _, special = _parts(path)
    return _labels(vocab, special)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text.

    path: a byte-level BPE vocabulary in the tokenizers library's JSON, readable on every executor. Null and empty texts
    have no ids; repeated rows are encoded each; other columns are ignored; an empty table gives an empty one. Special
    tokens' strings inside texts become their ids, as by the library's default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = load(path)
        for b in pieces(batches, 1):
            rows = [a.encode_text(t or "") for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows)))], names=[id_col, "ids"])
        load.cache_clear()  # a worker outlives its task; others need the memory more than the quarter of a second

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, text): the text that the ids spell; a null list is taken as empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = load_labels(path)
        for batch in batches:
            at = 0
            size = [0 if n is None else n for n in batch.column(1).value_lengths().to_pylist()]
            while at < len(batch):
                to, some = at + 1, size[at]
                while to < len(batch) and some + size[to] <= 1 << 20:
                    some += size[to]
                    to += 1
                b = batch.slice(at, to - at)
                at = to
                texts = [spelled(labels, x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, text): decode(encode(docs)) in one pass, so that a core has one Python worker and no ids travel twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = load(path)
        for b in pieces(batches, 1):
            rows = [a.encode_text(t or "") for t in b.column(1).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            texts = pa.array([a.decode(r.tolist()) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows))), texts], names=[id_col, "ids", "text"])
        load.cache_clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, text string")
