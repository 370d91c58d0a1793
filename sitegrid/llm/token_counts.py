"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

A first pass lists the frequent pre-tokens: every task keeps a bounded summary of all its rows and hands on its heaviest
few as one row; these summaries are merged group by group, never by word, and the heaviest of the last, with their lengths
in tokens, make a table of at most ``entries`` entries that is broadcast. The second pass splits the texts, looks lengths up in that table, and encodes
what is missing through a bounded cache in each worker. The table only saves time: counts don't depend on it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegrid.llm.bpe import Recent, byte_chars, unsure
from sitegrid.llm.common import arrow_map, pieces

SLOW = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
LETTERS = "".join(chr(c) for c in range(256) if regex.match(r"\p{L}", chr(c)))
NUMBERS = "".join(chr(c) for c in range(256) if regex.match(r"\p{N}", chr(c)))
FAST = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")
#: Longest pre-token, in characters, that the broadcast table may hold.
WIDE = 32


class Counts:
    """The tokens of texts, by the library's vocabulary at path."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        chars = byte_chars()
        self.chars = {b: c for c, b in chars.items()}
        self.model = self.library.model
        self.sizes = Recent(self.measure)

    def measure(self, word: str) -> int:
        return len(self.model.tokenize("".join(map(self.chars.__getitem__, word.encode()))))

    def split(self, text: str) -> tuple[list[str] | None, int]:
        """The pre-tokens of text, lower-cased, and the number of special tokens in it. None: the library has to count."""
        special = 0
        if self.cut and "<|" in text:
            text, special = self.cut.subn(" ", text)
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if unsure().search(text):
                    return None, special
                # the library lower-cases letter by letter, so a sigma at the end of a word is like any other
                return SLOW.findall(text.replace("\u03a3", "\u03c3").lower()), special
        return FAST.findall(text.lower()), special

    def count(self, text: str) -> int:
        words, special = self.split(text)
        if words is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.sizes.__getitem__, words)) + special


@lru_cache(2)
def load(path: str) -> Counts:
    out = Counts(path)
    out.library.no_truncation()
    out.library.no_padding()
    return out


def frequent(docs: DataFrame, path: str, entries: int, each: int, text_col: str = "text") -> list[str]:
    """The heaviest pre-tokens of all rows, at most entries of them."""
    schema = pa.schema([("words", pa.string()), ("n", pa.list_(pa.int64()))])

    def summary(top: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"words": "\n".join(w for w, _ in top), "n": [n for _, n in top]}] if top else [], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = load(path), Counter()
        for b in pieces(batches, 0):
            for t in b.column(0).to_pylist():
                seen.update(c.split(t)[0] or () if t else ())
            if len(seen) > 300_000:
                seen = Counter(dict(seen.most_common(100_000)))
        yield summary([(w, n) for w, n in seen.most_common(each) if len(w) <= WIDE and n > 1])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, x in zip(words.split("\n"), n, strict=True):
                    seen[w] += x
            if len(seen) > 300_000:
                seen = Counter(dict(seen.most_common(100_000)))
        yield summary(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries])

    some = arrow_map(docs.select(text_col), run, "words string, n array<long>")
    for groups in (64, 8, 1):
        some = some.repartition(groups).mapInArrow(merge, "words string, n array<long>")
    last = some.collect()
    return last[0].words.split("\n") if last else []


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 32_768, each: int = 8_192) -> DataFrame:
    """(id_col, n_bytes, n_tokens: long) of every whole text.

    path: a vocabulary in the tokenizers library's JSON with byte-level words that end in a marker, readable on every
    executor. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each; other columns are ignored; an
    empty table gives an empty one. The broadcast table holds at most entries words of WIDE characters: under 5 MB.
    """
    top = frequent(docs, path, entries, each, text_col)
    c = load(path)
    small = docs.sparkSession.sparkContext.broadcast(("\n".join(top), np.array([min(255, c.measure(w)) for w in top], np.uint8)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = load(path)
        words, sizes = small.value
        table = Recent(c.measure)
        table.old = dict(zip(words.split("\n"), sizes.tolist(), strict=True)) if len(sizes) else {}
        c.sizes = table
        for b in pieces(batches, 1):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array([c.count(t) if t else 0 for t in texts], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
