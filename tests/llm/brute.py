"""Plain versions of what the text operators compute, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

EDGE_TEXTS = [
    None, "", " ", "\t\n\r\x0b\x0c ", "word", "two words", "Two WORDS", "a b c d e f g", "A B C D E F G", " x y", "naïve café Straße", "日本語 テキスト", "é combining", "emoji 👩‍👩‍👧 🏳️‍🌈",
    "line one\nline two\n\nline one", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "<|startoftext|> hi", "'s 'S don't I'LL we've", "12 345 1,000.5", "   lead", "trail   ", "tabs\t\tand\r\nlines", "\x00 nul", "ÀÉÎ ﬁ Ⅷ ²", "a" * 5000, "ab " * 3000, "é" * 2000, "!?" * 500,
]


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def find_root(links: list[tuple[int, int]], ids) -> dict[int, int]:
    """The smallest id that links reach, for each id."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def near_duplicates(docs: list[tuple], k: int, percent: int = 80) -> dict[int, tuple]:
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    common = Counter()
    for group in by.values():
        g = sorted(group)
        common.update((a, b) for n, a in enumerate(g) for b in g[n + 1 :])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    root = find_root(links, sets)
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for n, (kind, pattern, ok) in enumerate([
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 10 <= len(digits(s)) <= 15),
    ]):
        out += [(m.start(), n, m.end(), kind) for m in pattern.finditer(t) if ok(m.group())]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def base_scores(docs: list[tuple]) -> dict[int, tuple]:
    tokens = {i: [*words(t), None] for i, t in docs}
    c = Counter(x for i, ts in tokens.items() if crc(i) % 5 != 1 for x in ts)
    n, v = sum(c.values()), len(c)
    return {i: (crc(i) % 5 == 1, len(ts), sum(c[x] > 0 for x in ts), n, math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for i, ts in tokens.items()}


def good_vector(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def near_vectors(rows: list[tuple], threshold: float = 0.98) -> dict[int, tuple]:
    """rows (id, vector, label)"""
    links, count = [], Counter()
    groups = defaultdict(list)
    for i, v, label in rows:
        if label is not None and good_vector(v):
            groups[label, len(v)].append((i, v))
    for g in groups.values():
        m = np.array([v for _, v in g], np.float64)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True):
            links.append((g[a][0], g[b][0]))
            count.update((g[a][0], g[b][0]))
    root = find_root(links, [r[0] for r in rows])
    return {i: (count[i], root[i], root[i] == i) for i in root}


def nearest(rows: list[tuple], k: int = 20, every: int = 20) -> dict[int, list[tuple[int, float]]]:
    ok = [(i, np.array(v, np.float64)) for i, v in rows if good_vector(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            found = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def mix_targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Targets by repeated resharing of what lies above the caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
