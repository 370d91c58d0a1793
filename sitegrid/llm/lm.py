"""LM scoring: log-bilinear models trained in numpy by noise-contrastive estimation, over exact corpus counts.

Counts of every training token come from map-side counters and one aggregation. The ``size`` most frequent words and one class
for all others are predicted from the two words before: one log-bilinear model looks at the word before, one at the word
before that, each with score(w | v) = r_v . q_w + b_w, and a text's probability mixes both with the words' own shares.

The models learn from the counts of all pairs of such words in the training texts, so every position counts and neither order
nor partitioning matters. Contexts are dealt to a fixed number of groups; in each round every group takes a few passes over
its contexts from the same start, and the groups' parameters are averaged. Noise-contrastive estimation tells each pair from
noise words; as the contexts of a pass are few, the expectation over noise is taken over all words instead of a few draws.
Normalising sums for all contexts come from products of whole matrices, once. A word of the class for others gets the class's
probability times its own smoothed share in the class.

Frequent words' counts are broadcast in a bounded table; the rest of a document's words meets the counts in a join by
word, with each document's repeats added up before.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import arrow_map, materialize, pieces

#: The token that ends a text; no word is empty.
END = b""
#: Longest word, in bytes, of the broadcast table.
WIDE = 64
#: Noise words for each word, in expectation.
NOISE = 20.0


class Bilinear:
    """One model: rows r of contexts, q and b of words, and the squared gradients that set their steps."""

    def __init__(self, contexts: int, unigram: np.ndarray, dim: int) -> None:
        rng, n = np.random.default_rng(11), len(unigram)
        self.parts = [rng.normal(0, 0.1, (contexts, dim)).astype(np.float32), rng.normal(0, 0.1, (n, dim)).astype(np.float32), np.log(unigram).astype(np.float32)]
        self.parts += [np.full(x.shape, 1e-4, np.float32) for x in self.parts]

    def learn(self, at: np.ndarray, counts: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
        """One Adagrad step on whole contexts: at are their numbers, counts[i, w] how often w follows the i-th."""
        r, q, b, seen_r, seen_q, seen_b = self.parts
        total = counts.sum(1, keepdims=True)
        z = r[at] @ q.T
        z += b - log_noise
        np.clip(z, -30, 30, out=z)
        s = 1 / (1 + np.exp(-z))
        noise = np.exp(log_noise)
        g = counts * (1 - s) - total * noise * s
        g /= np.sqrt(total.mean() * total + 1)  # between equal weights of contexts and equal weights of positions
        steps = ((r, seen_r, at, g @ q), (q, seen_q, slice(None), g.T @ r[at]), (b, seen_b, slice(None), g.sum(0)))
        for x, seen, i, grad in steps:
            seen[i] += grad * grad
            x[i] += rate * grad / np.sqrt(seen[i])

    def norms(self) -> np.ndarray:
        """For each context the logarithm of the sum over all words."""
        r, q, b = self.parts[:3]
        out = np.empty(len(r), np.float32)
        for i in range(0, len(r), 512):
            z = r[i : i + 512] @ q.T + b
            top = z.max(1)
            out[i : i + 512] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return out


class Mixture:
    """Models of the word before and of the one before that, and the words' own shares, with fixed weights."""

    def __init__(self, models: list[tuple], unigram: np.ndarray, weights: tuple[float, ...]) -> None:
        self.models, self.unigram, self.weights = models, unigram.astype(np.float32), weights

    def log10_prob(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The normalised log10 probability of each w after u, v."""
        out = np.empty(len(w))
        for i in range(0, len(w), 32_768):
            j = slice(i, i + 32_768)
            p = self.weights[2] * self.unigram[w[j]]
            for (r, q, b, norm), x, weight in zip(self.models, (v, u), self.weights, strict=False):
                p = p + weight * np.exp(np.einsum("ij,ij->i", r[x[j]], q[w[j]]) + b[w[j]] - norm[x[j]])
            out[j] = np.log10(p)
        return out


def _contexts(w: np.ndarray, size: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' classes w, size of them in each: the two before each, and where texts begin."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    v = np.concatenate([[begin], w[:-1]])
    v[start] = begin
    u = np.concatenate([[begin], v[:-1]])
    u[start] = begin
    return u, v, start


class _Classes(dict):
    def __missing__(self, word: bytes) -> int:
        return 1


def _tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, keys in order."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def pairs(docs: DataFrame, words, classes: int, train, groups: int) -> DataFrame:
    """docs(id, text) -> (part, keys, n: binary) with one row a group: counts of pairs in all training texts.

    A key is context * classes + word; contexts of the second model come after those of the first. A context's group is its
    number modulo groups. A task hands on sums of its own pairs; they are added up by context and a salt first, then by group.
    """
    size = classes + 1
    shape = "part int, salt int, context int, keys binary, n binary"
    names = ["part", "salt", "context", "keys", "n"]

    def rows(keys: np.ndarray, n: np.ndarray, salt: int) -> pa.RecordBatch:
        context = keys // classes
        first = np.flatnonzero(np.diff(context, prepend=-1))
        ends = [*first[1:].tolist(), len(keys)]
        at = context[first]
        low, n = (keys - context * classes).astype(np.uint16), n.astype(np.int64)
        spans = list(zip(first.tolist(), ends, strict=True))
        return pa.RecordBatch.from_arrays([pa.array((at % groups).astype(np.int32)), pa.array(np.full(len(at), salt, np.int32)), pa.array(at.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, salt = _Classes(words.value[2]).__getitem__, [], 0
        for b in pieces(batches, 1):
            texts = [_tokens(t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if train(i)]
            if not texts:
                continue
            count = np.array([len(t) for t in texts])
            w = np.fromiter((c for t in texts for c in map(get, t)), np.int64, count.sum())
            salt = (salt + int(w.sum())) % 16
            u, v, _ = _contexts(w, count, classes)
            keys, n = np.unique(np.concatenate([v * classes + w, (size + u) * classes + w]), return_counts=True)
            held.append((keys, n))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [_add(held)]
                if len(held[0][0]) > 3_000_000:
                    yield rows(*held.pop(), salt)
        if held:
            yield rows(*_add(held), salt)

    def merge(by_group: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for part, salt, context, keys, n in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    mark = part if by_group else (salt, context)
                    if mark != now and held:
                        yield out(now, held)
                        held = []
                    now = mark
                    held.append((np.frombuffer(keys, np.uint16).astype(np.int64) + context * classes, np.frombuffer(n, np.int64)))
                    if sum(len(k) for k, _ in held) > 4_000_000:
                        held = [_add(held)]
            if held:
                yield out(now, held)

        def out(now, held: list) -> pa.RecordBatch:
            keys, n = _add(held)
            if not by_group:
                return rows(keys, n, now[0])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["part", "keys", "n"])

        return run

    first = arrow_map(docs, gather, shape).repartition("context", "salt").sortWithinPartitions("salt", "context").mapInArrow(merge(False), shape)
    return first.repartition("part").sortWithinPartitions("part", "context").mapInArrow(merge(True), "part int, keys binary, n binary")


def fit(table: DataFrame, classes: int, unigram: np.ndarray, dim: int, groups: int, rounds: int, passes: int, rate: float = 0.1, block: int = 128) -> list[Bilinear]:
    """The two models, learned from pairs' table."""
    spark = table.sparkSession
    noise = unigram**0.75 / (unigram**0.75).sum()
    log_noise = np.log(NOISE * noise).astype(np.float32)
    models = [Bilinear(classes + 1, unigram, dim) for _ in range(2)]
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast([m.parts for m in models])

        def train(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, keys, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                    for kind in range(2):
                        m = Bilinear.__new__(Bilinear)
                        m.parts = [x.copy() for x in shared.value[kind]]
                        context = keys // classes - kind * (classes + 1)
                        mine = (context >= 0) & (context <= classes)
                        at, word, count = context[mine], keys[mine] % classes, n[mine]
                        own, row = np.unique(at, return_inverse=True)
                        rng = np.random.default_rng((part, turn, kind))
                        for _ in range(passes):
                            order = rng.permutation(len(own))
                            for i in range(0, len(order), block):
                                some = order[i : i + block]
                                place = np.full(len(own), -1)
                                place[some] = np.arange(len(some))
                                on = place[row] >= 0
                                dense = np.zeros((len(some), classes), np.float32)
                                dense[place[row[on]], word[on]] = count[on]
                                m.learn(own[some], dense, log_noise, rate)
                        r, q, bias, seen_r, seen_q, seen_b = m.parts
                        blob = [own.astype(np.int32), r[own], seen_r[own], q, bias, seen_q, seen_b]
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([float(count.sum())]), pa.array([[x.tobytes() for x in blob]], pa.list_(pa.binary()))], names=["part", "kind", "mass", "blob"])

        def average(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            new: dict = {}
            for b in batches:
                for kind, mass, blob in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    start = shared.value[kind]
                    parts, total = new.setdefault(kind, ([start[0].copy(), *(np.zeros(x.shape) for x in start[1:3]), start[3].copy(), *(np.zeros(x.shape) for x in start[4:])], [0.0]))
                    own = np.frombuffer(blob[0], np.int32)
                    for i, j in ((0, 1), (3, 2)):
                        parts[i][own] = np.frombuffer(blob[j], np.float32).reshape(-1, dim)
                    for i, j in ((1, 3), (2, 4), (4, 5), (5, 6)):
                        parts[i] += mass * np.frombuffer(blob[j], np.float32).reshape(parts[i].shape)
                    total[0] += mass
            for kind, (parts, total) in new.items():
                if total[0]:
                    out = [x if i in (0, 3) else (x / total[0]).astype(np.float32) for i, x in enumerate(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([kind], pa.int32()), pa.array(total), pa.array([[x.tobytes() for x in out]], pa.list_(pa.binary()))], names=["part", "kind", "mass", "blob"])

        shape = "part int, kind int, mass double, blob array<binary>"
        learned = table.mapInArrow(train, shape).repartition("kind").sortWithinPartitions("kind", "part")
        for x in learned.mapInArrow(average, shape).collect():
            models[x.kind].parts = [np.frombuffer(blob, np.float32).reshape(old.shape) for blob, old in zip(x.blob, models[x.kind].parts, strict=True)]
        shared.destroy()
    return models


def score(docs: DataFrame, folds: int = 5, held: int = 1, size: int = 4094, dim: int = 32, table: int = 131_072, groups: int = 8, rounds: int = 6, passes: int = 10, weights: tuple[float, ...] = (0.7, 0.2, 0.1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every whole text.

    Learns from texts whose crc32 of the id as text, modulo folds, is not held. Tokens: words that blanks separate, A-Z
    lower-cased, and one end of the text. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))); score is the model's log10
    probability. Null and empty texts are an end only. Without any training text, N = V = 0. Repeated rows are learned
    from and scored each; rows without an id are learned from. Ids are longs; other columns are ignored; an empty table
    gives an empty one. Results depend on neither order nor partitioning of the rows, but for rounding. table: words whose
    counts are broadcast, at most 64 bytes each. weights: of the two models and of the words' own shares.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % folds != held

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return b

        for b in pieces(batches, 1):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if train(i):
                    seen.update((t or "").encode().lower().split())
                    seen[END] += 1
            if len(seen) > 400_000:
                yield out()
        yield out()

    counts = materialize(arrow_map(d, count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    v_all, n_all = (int(x or 0) for x in counts.agg(F.count("*"), F.sum("c")).first())
    top = [(r.word.encode(), r.c) for r in counts.where(F.octet_length("word") <= WIDE).orderBy(F.desc("c"), "word").limit(table).toLocalIterator()]
    classes = 2 + min(size, len(top))
    model_words = {w: 2 + i for i, (w, _) in enumerate([x for x in top if x[0] != END][:size])} | {END: 0}
    in_model = sum(c for w, c in top if w in model_words)
    n_other, v_other = n_all - in_model, v_all - sum(w in model_words for w, _ in top)
    unigram = np.full(classes, 0.5)
    for w, c in top:
        if w in model_words:
            unigram[model_words[w]] += c
    unigram[1] += n_other
    unigram /= unigram.sum()
    words = spark.sparkContext.broadcast((b"\n".join(w for w, _ in top), np.array([c for _, c in top], np.int64), model_words))

    counted = materialize(pairs(d.select("id", "text"), words, classes, train, groups), "pairs")
    models = fit(counted, classes, unigram, dim, groups, rounds, passes)
    shared = spark.sparkContext.broadcast(Mixture([(*m.parts[:3], m.norms()) for m in models], unigram, weights))
    low, low_other = n_all + 0.5 * (v_all + 1), n_other + 0.5 * (v_other + 1)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        joined, c, model_words = words.value
        get = _Classes(model_words).__getitem__
        known = dict(zip(joined.split(b"\n"), range(len(c)), strict=True)) if len(c) else {}
        base = np.log10((c + 0.5) / low)
        extra = np.log10((c + 0.5) / low_other) * np.array([w not in model_words for w in known], float)
        base, extra = base.tolist(), extra.tolist()
        for b in pieces(batches, 1):
            rows, kinds, head, rare = b.column(2).to_pylist(), [], [], []
            for row, t in zip(rows, b.column(1).to_pylist(), strict=True):
                tokens = _tokens(t)
                kinds.append(np.fromiter(map(get, tokens), np.int64, len(tokens)))
                n_known, sum_base, sum_extra = 0, 0.0, 0.0
                for x, n in Counter(tokens).items():
                    at = known.get(x)
                    if at is None:
                        rare.append((row, x, n))
                    else:
                        n_known += n
                        sum_base += n * base[at]
                        sum_extra += n * extra[at]
                head.append((len(tokens), n_known, sum_base, sum_extra))
            w = np.concatenate(kinds)
            u, v, start = _contexts(w, np.array([len(x) for x in kinds]), classes)
            prob = np.add.reduceat(model.log10_prob(u, v, w), start)
            n, k, s, e = zip(*head, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.nulls(len(rows), pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.float64()), pa.array(np.array(e) + prob, pa.float64())], names=["row", "id", "word", "n", "known", "base", "model"])
            if rare:
                r, x, n = zip(*rare, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(x, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.float64()), pa.nulls(len(r), pa.float64())], names=["row", "id", "word", "n", "known", "base", "model"])

    # a row number of its own tells repeated rows apart; it is written once, with what hangs on it
    rows = materialize(arrow_map(d.withColumn("row", F.monotonically_increasing_id()), rate, "row long, id long, word string, n long, known long, base double, model double"), "rows")
    c = F.coalesce("c", F.lit(0))
    rare = rows.where("word is not null").select("row", "word", "n").join(counts, "word", "left").select("row", F.lit(0).cast("long").alias("tokens"), F.when(c > 0, F.col("n")).otherwise(0).cast("long").alias("known"), (F.col("n") * F.log10((c + 0.5) / low)).alias("base"), (F.col("n") * F.log10((c + 0.5) / low_other)).alias("model"))
    whole = rows.where("word is null").select("row", "id", F.col("n").alias("tokens"), "known", "base", "model")
    total = whole.unionByName(rare.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("tokens", "known", "base", "model"))), allowMissingColumns=True).groupBy("row").agg(F.max("id").alias("id"), *(F.sum(x).alias(x) for x in ("tokens", "known", "base", "model")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)) == held, F.lit(False))
    return total.select(F.col("id").alias(id_col), held_out.alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))
