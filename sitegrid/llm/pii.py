"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base spans follow fixed patterns and always stay. Between them, candidate segments
around digits, at-signs, (at) and [at], after key words, and in capitals are scored as whole spans: features see the full segment and its surroundings, such as digit counts, groups, checksums, key words
and clean edges. A path of the model divides a stretch into entities and plain characters; an entity is no longer than
WIDEST characters, plain text scores 0. Dynamic programming over segment ends finds the best path, choosing boundaries
and kinds together. Weights are learned by conditional likelihood, with the same lattice, on texts from a seeded
generator that plants entities and lookalikes (versions, dates, prices, identifiers).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitegrid.llm.common import arrow_map, pieces

#: In the order that breaks ties between spans that start together.
KINDS = ("email", "ip", "card", "phone", "secret")
WIDEST = 128
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@(\[](?:(?<=[0-9@])|(?<=\()at\)|(?<=\[)at\])")
#: Values that key words announce, and keys in capitals; neither needs a digit or an at-sign.
_SAID = re.compile(r"(?i:token|password|passwd|secret|api[ _-]?key|pwd)[\"']? ?[=:] ?[\"']?([^\s\"'<>,;|&?#=]{8,128})")
_CAPITALS = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{16,64}(?![A-Za-z0-9])")
_PLAIN = frozenset(" \t\r\n\v\f\"'<>,;|")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            s = at
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end(), 0))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    if _HOT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


_CUES = [re.compile(p, re.I) for p in (r"(?:token|password|passwd|secret|api.?key|pwd)\W{1,4}$", r"(?:tel|phone|call|fax|mobile)\W{0,3}$", r"(?:card|visa|credit|iban)\W{0,3}$", r"(?:mail|contact|write to)\W{0,3}$", r"(?:version|v|no|page|section|chapter|figure)\W{0,2}$")]
_MONTHS = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}")
_MASKED_MAIL = re.compile(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?[\w-]+")
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+")
_KEY = re.compile(r"[A-Z]{2,6}[A-Z0-9]{12,}")
_ACCESS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_HEX = re.compile(r"[0-9a-f]{16,}")


@lru_cache(4096)
def _inside(s: str) -> tuple[float, ...]:
    d = _digits(s)
    n, groups = len(d), [len(g) for g in re.findall(r"[0-9]+", s)]
    letters, upper = sum(c.isalpha() for c in s), sum("A" <= c <= "Z" for c in s)
    return (
        1, n == 10, 11 <= n <= 12, n == 13, 14 <= n <= 19, n > 19, n < 7, 14 <= n <= 19 and luhn(d), s.count(".") == 3 and len(groups) == 4 and max(groups) <= 3 and all(int(g) <= 255 for g in re.findall(r"[0-9]+", s)),
        len(groups) == 1, groups[:1] == [3] and groups[-2:] == [3, 4], groups[-2:] == [3, 4], len(groups) == 4 and set(groups) == {4}, "@" in s, _MASKED_MAIL.fullmatch(s) is not None, s[0] == "+", s[0] == "(", s.count("-") >= 2, " " in s,
        letters == 0, letters > 0 and n > 0, letters == len(s) >= 10, letters == len(s) == upper, _ACCESS.fullmatch(s) is not None, ":" in s or "=" in s, _KEY.fullmatch(s) is not None, _HEX.fullmatch(s) is not None and letters > 0, upper > 8, len(s) >= 16, _MONTHS.fullmatch(s) is not None, len(groups) == 2 and s.count(".") == 1, not s[0].isalnum() and s[0] not in "+(", not s[-1].isalnum(), n / max(1, len(s)),
    )


def features(text: str, s: int, e: int) -> np.ndarray:
    """What the model sees of text[s:e] as one segment."""
    before = text[max(0, s - 16) : s]
    edge = [s == 0 or not text[s - 1].isalnum(), e == len(text) or not text[e].isalnum()]
    return np.array([*_inside(text[s:e]), *edge, edge[0] and edge[1], *(p.search(before) is not None for p in _CUES)], float)


WIDTH = len(_inside("1")) + 3 + len(_CUES)


def _mails(text: str, mark: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Segments around an at-sign or its like at mark that are addresses, one for each end of the domain."""
    b = mark - (mark > low and text[mark - 1] == " ")
    a = b
    while a > max(low, b - WIDEST) and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
        a -= 1
    x = _AT.match(text, b, high) if a < b else None
    while x and (x := _DOT.match(text, x.end(), high)) and x.end() - a <= WIDEST:
        yield a, x.end()


_PIECE = re.compile(r"[A-Za-z0-9_]+|[^\x00-\x7f]+|[^A-Za-z0-9_]")
_CLASS = re.compile(r"[0-9]+|[A-Za-z_]+")


def _inner(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Segments within the run text[low:high] between changes of character class, with a digit or an at-sign.

    Classes: digits, ASCII letters, other scripts; every other ASCII character is a piece. A word of 14 characters
    or more, as keys are, or of more than two classes is divided only at its runs of ten digits and more.
    """
    starts, ends = [], []
    for m in _PIECE.finditer(text, low, high):
        cut = [m.start(), m.end()]
        if m.group()[0].isascii() and len(parts := [x.span() for x in _CLASS.finditer(text, *m.span())]) > 1:
            some = parts if len(parts) == 2 and m.end() - m.start() < 14 else [x for x in parts if x[1] - x[0] >= 10 and text[x[0]].isdigit()]
            cut = sorted({*cut, *(p for x in some for p in x)})
        for a, b in zip(cut, cut[1:], strict=False):
            if text[a].isalnum() or text[a] in "+(":
                starts.append(a)
            if text[b - 1].isalnum():
                ends.append(b)
    hot, first = [m.start() for m in _HOT.finditer(text, low, high)], 0
    near = 0
    for a in starts:
        while near < len(hot) and hot[near] < a:
            near += 1
        if near == len(hot):
            break
        while first < len(ends) and ends[first] < a + 6:
            first += 1
        for b in ends[first:]:
            if b - a > WIDEST:
                break
            if hot[near] < b:
                yield a, b


def candidates(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Segments of text[low:high] that could be entities: chunks with a digit, an at-sign or its like, runs of up to five, addresses,
    what follows a key word, and keys in capitals."""
    chunks, out, at = [], set(), low
    for m in _SAID.finditer(text, low, high):
        a, b = m.span(1)
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if b - a >= 8:
            out.add((a, b))
    out.update(m.span() for m in _CAPITALS.finditer(text, low, high))
    while (m := _HOT.search(text, at, high)) is not None:
        s, e = m.start(), m.end()
        while s > max(low, m.start() - WIDEST) and text[s - 1] not in _PLAIN:
            s -= 1
        while e < min(high, m.start() + WIDEST) and text[e] not in _PLAIN:
            e += 1
        at = e
        while at < high and text[at] not in _PLAIN:
            at += 1
        if at - s > WIDEST or s <= m.start() - WIDEST:
            run = s
            while run > low and text[run - 1] not in _PLAIN:
                run -= 1
            for part in re.finditer(r"[^=&?#]+", text[run:at]):  # no entity goes on beyond these
                out.update(_inner(text, run + part.start(), run + part.end()))
            for mark in re.finditer(r"@|\(at\)|\[at\]", text[run:at]):
                out.update(_mails(text, run + mark.start(), low, high))
        if at == e and s > m.start() - WIDEST:
            for mark in re.finditer(r"@|\(at\)|\[at\]", text[s:e]):
                out.update(_mails(text, s + mark.start(), low, high))
            if "=" in text[s:e]:
                s = min(e - 1, text.index("=", s, e) + 1)
            chunks.append((s, e))
    for i, (s, first) in enumerate(chunks):
        e = first
        for j in range(i, min(i + 5, len(chunks))):
            if j > i and (chunks[j][0] - e > 2 or "\n" in text[e : chunks[j][0]]):
                break
            e = chunks[j][1]
            a, b = s, e
            while b > a and not text[b - 1].isalnum():
                b -= 1
            while a < b and not text[a].isalnum() and text[a] not in "+(":
                a += 1
            if 6 <= b - a <= WIDEST:
                out.add((a, b))
    return sorted(out)


def _lattice(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], np.ndarray]:
    return [0, *sorted({p for x in spans for p in x})], np.array([features(text, *x) for x in spans]).reshape(-1, WIDTH)


class Field:
    """The model: one row of weights for each kind."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.zeros((len(KINDS), WIDTH)) if weights is None else weights

    def best(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The entities of the best path through the segments of a stretch."""
        if not spans:
            return []
        points, x = _lattice(text, spans)
        scores = x @ self.weights.T
        place = {p: i for i, p in enumerate(points)}
        ends: dict[int, list[int]] = {}
        for i, (_, e) in enumerate(spans):
            ends.setdefault(place[e], []).append(i)
        value, back = [0.0] * len(points), [None] * len(points)
        for j in range(1, len(points)):
            value[j] = value[j - 1]
            for i in ends.get(j, ()):
                k = int(np.argmax(scores[i]))
                if (v := value[place[spans[i][0]]] + scores[i, k]) > value[j]:
                    value[j], back[j] = v, (i, k)
        out, j = [], len(points) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((*spans[i], k))
                j = place[spans[i][0]]
        return out[::-1]

    def slope(self, text: str, spans: list[tuple[int, int]], gold: list[tuple[int, int, int]]) -> np.ndarray:
        """The gradient of the log-likelihood of gold, by forward and backward sums over all paths."""
        points, x = _lattice(text, spans)
        scores, place = x @ self.weights.T, {p: i for i, p in enumerate(points)}
        n = len(points)
        forward, backward = np.full(n, -np.inf), np.full(n, -np.inf)
        forward[0], backward[-1] = 0, 0
        for j in range(1, n):
            forward[j] = forward[j - 1]
            for i, (s, e) in enumerate(spans):
                if place[e] == j:
                    forward[j] = np.logaddexp(forward[j], forward[place[s]] + np.logaddexp.reduce(scores[i]))
        for j in range(n - 2, -1, -1):
            backward[j] = backward[j + 1]
            for i, (s, e) in enumerate(spans):
                if place[s] == j:
                    backward[j] = np.logaddexp(backward[j], backward[place[e]] + np.logaddexp.reduce(scores[i]))
        grad = np.zeros_like(self.weights)
        for i, (s, e) in enumerate(spans):
            p = np.exp(forward[place[s]] + scores[i] + backward[place[e]] - forward[-1])
            grad -= p[:, None] * x[i]
            for k in range(len(KINDS)):
                if (s, e, k) in gold:
                    grad[k] += x[i]
        return grad


def generate(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with planted entities and lookalikes, and the entities' spans."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[r.integers(len(x))]
    word = lambda: "".join(r.choice(list("abcdeilnorstu"), r.integers(2, 9)))
    hexed = lambda k: "".join(r.choice(list("0123456789abcdef"), k))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, ".".join(d[i : i + 4] for i in range(0, 16, 4)), "/".join(d[i : i + 4] for i in range(0, 16, 4)))

    real = [
        (0, lambda: f"{word()}{pick('.', '_', '')}{word()} {pick('@', '(at)', '[at]')} {word()}{pick('.', ' (dot) ')}com".replace(" (at) ", pick("(at)", " @ ", "@"))), (0, lambda: f"{word()}{digits(2)}@{word()}.{pick('org', 'net', 'com')}"),
        (1, lambda: ".".join(str(x) for x in r.integers(1, 256, 4))), (2, card),
        (3, lambda: f"{pick('', '(')}{digits(3)}{pick(') ', '-', '.', ' ').replace(') ', '-')}{digits(3)}-{digits(4)}".replace("(", "")), (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), (3, lambda: f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}"),
        (4, lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(12, 28)))), (4, lambda: pick("AKIA", "ASIA") + "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 16))),
        (4, lambda: pick("AKIA", "ASIA") + "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))), (4, lambda: hexed(int(r.integers(16, 41)))), (4, lambda: word() + digits(3) + word().upper() + digits(4)),
    ]
    fake = [lambda: f"{r.integers(1, 9)}.{r.integers(0, 20)}", lambda: f"{r.integers(1, 9)}.{r.integers(0, 20)}.{r.integers(0, 20)}", lambda: f"{r.integers(1900, 2030)}-{r.integers(1, 13)}-{r.integers(1, 29)}", lambda: digits(int(r.integers(6, 13))), lambda: digits(int(r.integers(20, 40))), lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"{word()}{digits(5)}", lambda: f"{digits(4)}/{digits(4)}", lambda: f"{r.integers(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{word()}@{word()}", lambda: word().upper() + digits(6), lambda: digits(15), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(3)}-{digits(3)}:{word()}", lambda: f"{word()}:{digits(4)}-{word()}", lambda: f"{digits(3)} {digits(3)}", lambda: pick("token: ", "secret: ", "password = ") + word() + "ing", lambda: (word() + word() + word() + word() + word()).upper()[:24]]
    cue = {0: ["mail ", "contact: ", ""], 1: [""], 2: ["card ", ""], 3: ["tel. ", "call ", "phone: ", ""], 4: ["token = ", "password=", "secret: ", "api key: "]}
    out = []
    for _ in range(n):
        text, gold = word() + " ", []
        for _ in range(r.integers(1, 4)):
            if r.random() < 0.5:
                k, make = real[r.integers(len(real))]
                s = make()
                text += pick(*cue[k]) if k != 4 or not s[:4] in ("AKIA", "ASIA") else ""
                gold.append((len(text), len(text) + len(s), k))
            else:
                text += pick("", "", "version ", "no. ", "page ")
                s = fake[r.integers(len(fake))]()
            text += s + pick(" ", ". ", ", ", " ") + " ".join(word() for _ in range(r.integers(1, 4))) + " "
        out.append((text, gold))
    return out


@lru_cache(1)
def fit(texts: int = 800, rounds: int = 12) -> Field:
    """A model learned from generated texts. Base spans are taken out before, as when it is applied."""
    data = []
    for text, gold in generate(texts):
        fixed = base(text)
        spans = [x for x in candidates(text, 0, len(text)) if not any(x[0] < e and s < x[1] for s, e, _ in fixed)]
        if spans:
            data.append((text, spans, [g for g in gold if g[:2] in spans]))
    f, seen = Field(), 1e-6
    for _ in range(rounds):
        for text, spans, gold in data:
            g = f.slope(text, spans, gold) - 1e-4 * f.weights
            seen = seen + g * g
            f.weights += 0.3 * g / np.sqrt(seen)
    return f


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the added ones; these overlap neither each other nor the base."""
    fixed, added = base(text), []
    if not (_HOT.search(text) or _SAID.search(text) or _CAPITALS.search(text)):
        return fixed, added
    edges, at = [], 0
    for s, e, _ in fixed:
        if s > at:
            edges.append((at, s))
        at = max(at, e)
    edges.append((at, len(text)))
    for low, high in edges:
        spans = candidates(text, low, high)
        some: list[tuple[int, int]] = []
        reach = -1
        for x in spans:  # stretches of overlapping segments are independent
            if x[0] >= reach and some:
                added += field.best(text, some)
                some = []
            some.append(x)
            reach = max(reach, x[1])
        added += field.best(text, some)
    return fixed, added


def pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, added): arrays of (start, end, kind) spans in code points of every whole text.

    Null and empty texts have none. Repeated rows are searched each; other columns are ignored; an empty table gives an
    empty one. Entities over WIDEST characters are found by the base patterns only. Runs over WIDEST are divided where the
    class of characters changes; shorter ones keep their own edges.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field or fit()).weights)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(shared.value)
        for b in pieces(batches, 1):
            both = [find(t or "", f) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    one = "array<struct<start:int,end:int,kind:string>>"
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, base {one}, added {one}")
