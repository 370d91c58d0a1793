"""A quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; all documents of the training folds are the unlabelled ones. The
class prior is estimated from both by the best bin of a first classifier's scores: where unlabelled documents outnumber
positives least, nearly all of them are positive. A logistic model then minimises the non-negative unbiased risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). The positives are a bounded sample of the labelled rows; the unlabelled ones
are all documents of the training folds, whose part in a step is a sum over their table. Every document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import BLANKS, Tables, arrow_map, pieces, raw

#: Classes of bytes: 0 other, 1-3 lower-case letters, capitals, digits, 4 blanks, 5 newline, then marks one by one.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[BLANKS] = 4
CLASS[10] = 5
for _i, _c in enumerate((".", ",", "!", "|", "#", "\"'", "$%&*@^~+=<>", "()[]{}", "?;:-_/\\", "`")):
    for _x in _c:
        CLASS[ord(_x)] = 6 + min(_i, 8)
CLASS[128:] = 15
KINDS, EXTRA = 16, 16


def features(data: np.ndarray) -> np.ndarray:
    """What the model sees of a text's bytes: pairs of byte classes, and statistics of words and lines."""
    out = np.zeros(KINDS * KINDS + EXTRA, np.float32)
    n = len(data)
    if n < 2:
        return out
    c = CLASS[data]
    out[: KINDS * KINDS] = np.sqrt(np.bincount(c[:-1] * np.uint8(KINDS) + c[1:], minlength=KINDS * KINDS) / (n - 1))
    text = data.tobytes()
    words = text.split()
    if not words:
        return out
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x]
    w = len(words)
    sizes = np.fromiter(map(len, words), np.float64, w)
    half = words[: w // 2]
    out[KINDS * KINDS :] = [
        same / w, distinct / w ** 0.9, np.log1p(w) / 10, sizes.mean() / 10, sizes.std() / 10, min(sizes.max(), 100) / 100,
        sum(map(bytes.isupper, words)) / w, sum(map(bytes.istitle, words)) / w, sum(map(bytes.isalpha, words)) / w,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10, len(set(half) & set(words[w // 2 :])) / max(1, len(set(half))),
        (c == 3).mean(), (c == 2).mean(), float(w < 5), len(set(zip(words, words[1:], strict=False))) / w,
    ]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def prior(positive: np.ndarray, unlabelled: Callable[[np.ndarray], np.ndarray], n: int, least: float = 0.2) -> float:
    """An upper estimate of the share of positives among n unlabelled ones, from scores of both.

    unlabelled(cuts) counts the unlabelled scores from each cut on.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 41))
    over = np.array([(positive >= c).mean() for c in cuts])
    shares = unlabelled(cuts) / n / np.maximum(1e-9, over)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(len(positive)))
    return float(np.clip(shares[np.argmin(shares + slack / np.maximum(1e-9, over))], 0.05, 0.99))


#: Adds up what a function makes of the features of all unlabelled rows; None if there are none.
Sums = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray | None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals: the order in which partial sums arrive doesn't show."""
    return np.round(x, 6)


class Model:
    """Weights on standardised features. score(features) is the probability of good quality.

    positive: features of trusted positives. unlabelled: those of the unlabelled ones, or Sums over them. Each Newton step
    is one sum over all the unlabelled, so their number has no bound.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray | Sums, steps: int = 8, decay: float | None = None) -> None:
        rows: Sums = unlabelled if callable(unlabelled) else lambda f: f(unlabelled) if len(unlabelled) else None
        width = positive.shape[1]
        self.mean, self.std, self.weights = np.zeros(width), np.ones(width), np.zeros(width + 1)
        self.prior, self.share = 1.0, 1.0
        decay = max(1e-3, 1 / max(1, len(positive))) if decay is None else decay
        moments = rows(lambda x: np.concatenate([[len(x)], x.sum(0, np.float64), (x.astype(np.float64) ** 2).sum(0)]))
        if moments is None or not len(positive):
            self.weights[0] = 3.0  # nothing to learn from: everything passes
            return
        n, (first, second) = moments[0], moments[1:].reshape(2, -1) / moments[0]
        self.mean, self.std = _rounded(first), _rounded(np.sqrt(np.maximum(0, second - first**2)) + 1e-3)
        scaled, good = self._scaled, self._scaled(positive)

        def parts(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Mean loss of the unlabelled as negatives, with its gradient and curvature."""

            def f(x: np.ndarray) -> np.ndarray:
                x = scaled(x)
                z = x @ w
                s = _sigmoid(z)
                return np.concatenate([[np.logaddexp(0, z).sum()], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

            out = rows(f) / n
            return out[0], out[1 : width + 2], out[width + 2 :].reshape(width + 1, -1)

        def newton(risk: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray, float]], w: np.ndarray) -> tuple[np.ndarray, float]:
            """The least risk, from w on; a step that doesn't lower it is halved until it does. Gives the negatives' part there, too."""
            value, slope, bend, other = risk(w)
            step = -np.linalg.solve(bend + decay * np.eye(len(w)), slope)
            for _ in range(steps):
                new = risk(w + step)
                if new[0] > value:
                    step = step / 2
                    continue
                w, gain, (value, slope, bend, other) = w + step, value - new[0], new
                step = -np.linalg.solve(bend + decay * np.eye(len(w)), slope)
                if gain < 1e-6:
                    break
            return w, other

        def mixed(w: np.ndarray, a: float, b: float, c: float) -> tuple[float, np.ndarray, np.ndarray, float]:
            """a * R_u(-) + b * R_p(+) - c * R_p(score) + decay, with gradient, curvature without decay's own, and the negatives' part."""
            loss, slope, bend = parts(w)
            z = good @ w
            s = _sigmoid(-z)
            own = ((good * (s * (1 - s))[:, None]).T @ good) / len(good)
            value = a * loss + b * np.logaddexp(0, -z).mean() - c * z.mean() + decay * (w @ w) / 2
            return value, a * slope - b * (good.T @ s) / len(good) - c * good.mean(0) + decay * w, a * bend + b * own, loss - self.prior * np.logaddexp(0, z).mean()

        # positives against unlabelled, both of weight one half
        w = _rounded(newton(lambda w: mixed(w, 0.5, 0.5, 0.0), np.zeros(width + 1))[0])
        count = lambda cuts: rows(lambda x: (np.round(scaled(x) @ w, 9)[:, None] >= cuts).sum(0).astype(np.float64))
        self.prior = prior(np.round(good @ w, 9), count, n)
        # max(0, x) is the most that share * x gives for a share of 0 to 1. A positive's two losses differ by its score, so the
        # risk is convex for any share; the share falls until the negatives' part is not below zero
        share, w = 1.0, np.zeros(width + 1)
        while True:
            w, other = newton(lambda w, t=share: mixed(w, t, (1 - t) * self.prior, t * self.prior), w)
            if other > -1e-3 or share < 0.1:
                break
            share *= 0.8
        self.weights, self.share = _rounded(w), share

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.std, -8, 8)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._scaled(x) @ self.weights)


def _features_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            data, off = raw(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(data[i:j]).tobytes() for i, j in zip(off, off[1:], strict=False)], pa.binary())], names=["id", "x"])

    return arrow_map(docs.select(id_col, text_col), run, "id long, x binary")


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, KINDS * KINDS + EXTRA)


def _over(rows: DataFrame) -> Sums:
    """Sums over rows(x binary): of each task, then of about the root of their number of tasks, then in the driver."""
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def sums(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if len(b):
                    part = f(_stack(b.column(0)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = None, None
            for b in batches:
                for part, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total = np.frombuffer(s) if total is None else total + np.frombuffer(s)
                    first = part if first is None else first
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

        few = arrow_map(rows.select("x"), each, "part long, s binary").repartition(fan).sortWithinPartitions("part")
        got = sorted(arrow_map(few, merge, "part long, s binary").collect())
        return sum(np.frombuffer(r.s) for r in got) if got else None

    return sums


def _smallest(ids: DataFrame, n: int, bins: int = 1 << 16) -> list[int]:
    """The n distinct ids of the smallest hashes. Counts by bins of hashes tell from which bin on no id is among them, so
    tasks send the driver little more than n in all."""
    d = ids.toDF("id").where("id is not null").distinct().withColumn("h", F.xxhash64(F.lit(1), "id"))
    d = d.withColumn("bin", F.shiftright("h", 64 - bins.bit_length() + 1))
    seen, last = 0, None
    for r in sorted(d.groupBy("bin").count().collect()):
        if seen >= n:
            break
        seen, last = seen + r[1], r.bin
    return [r.id for r in d.where(F.col("bin") <= last).orderBy("h", "id").limit(n).collect()] if seen else []


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, positives: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learned from all documents outside the held fold as the unlabelled ones, each row by its own text, and at most
    positives of those that labels mark, the ones of the smallest hashes; of rows with the same id, one text.

    labels(doc_id, quality): quality 1 marks trusted positives; null and other values mark nothing.
    """
    ours = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(folds)) != held
    with Tables(docs.sparkSession) as keep:
        rows = keep(_features_of(docs.where(ours(id_col)), id_col, text_col), "features")
        ids = docs.sparkSession.createDataFrame([(i,) for i in _smallest(labels.where("quality = 1").where(ours(id_col)).select(id_col), positives)], "id long")
        good = rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()
        return Model(_stack(pa.array([bytes(r.x) for r in good], pa.binary())), _over(rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double) of every whole text; null and empty texts get the score of no features. Other columns are
    ignored, repeated rows scored each; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, 1):
            data, off = raw(b.column(1))
            x = np.array([features(data[i:j]) for i, j in zip(off, off[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], names=[id_col, "score"])

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all of their columns, whose texts score at least threshold. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in pieces(batches, at):
            data, off = raw(b.column(at))
            good = m.score(np.array([features(data[i:j]) for i, j in zip(off, off[1:], strict=False)])) >= threshold
            if good.any():
                yield b.filter(pa.array(good))

    return arrow_map(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels' rows in the held-out fold are never learned from. Rows without an id
    are scored, neither learned from nor held out."""
    m = train(docs, labels, **how)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(how.get("folds", 5))) == how.get("held", 0), F.lit(False))
    return score(docs, m).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
