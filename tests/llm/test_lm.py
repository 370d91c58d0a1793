import numpy as np
import pytest

from sitegrid.llm import lm
from sitegrid.llm.queries import queries
from tests.llm import brute
from tests.llm.brute import EDGE_TEXTS


def check(got, docs):
    want = brute.base_scores(docs)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 or total == 0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries()["op5_lm"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    check(got, docs)
    held = [r for r in got if r.held_out]
    bits = lambda c: -sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    print("held out, log10 a token: base", bits("base_score"), "model", bits("score"))
    assert bits("score") < bits("base_score")


def test_edges(spark):
    docs = list(enumerate(EDGE_TEXTS))
    df = spark.createDataFrame([(i, t, i, "x", 1) for i, t in docs], "doc_id long, text string, row long, word string, c long")
    check(lm.score(df).collect(), docs)
    assert lm.score(df.limit(0)).collect() == []
    more = spark.createDataFrame([(4, "word two", 0, "", 0), (4, "word two", 0, "", 0), (None, "word", 0, "", 0)], df.schema)
    out = lm.score(more).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in out) == [(0, 2, 8), (4, 3, 8), (4, 3, 8)]


def test_words_outside_the_table(spark):
    """The joined part and the broadcast part give the same as one."""
    docs = [(i, " ".join(f"w{(i * j) % 90}" for j in range(1, 60))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(lm.score(df, table=5, size=3).collect(), docs)


def test_probabilities_add_up():
    r = np.random.default_rng(0)
    unigram = np.full(40, 1 / 40)
    models = [lm.Bilinear(41, unigram, 8) for _ in range(2)]
    for m in models:
        for _ in range(20):
            m.learn(np.arange(41), r.integers(0, 9, (41, 40)).astype(np.float32), np.log(lm.NOISE * unigram).astype(np.float32), 0.1)
    mixed = lm.Mixture([(*m.parts[:3], m.norms()) for m in models], unigram, (0.6, 0.3, 0.1))
    every = np.arange(40)
    for u, v in ((40, 40), (3, 7)):
        p = 10 ** mixed.log10_prob(np.full(40, u), np.full(40, v), every)
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_noise_contrastive_steps_find_the_distribution():
    want = np.array([[0.5, 0.3, 0.15, 0.05], [0.05, 0.05, 0.1, 0.8]])
    m = lm.Bilinear(2, np.full(4, 0.25), 4)
    for _ in range(3000):
        m.learn(np.arange(2), (1000 * want).astype(np.float32), np.log(np.full(4, lm.NOISE / 4)).astype(np.float32), 0.05)
    r, q, b = m.parts[:3]
    p = np.exp(r @ q.T + b - m.norms()[:, None])
    assert np.abs(p - want).max() < 0.03


def test_pairs_of_every_position(spark):
    """Counts of pairs against a plain count, whatever the partitions; rows that aren't trained on give none."""
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, i % 9))) for i in range(60)] + [(60, None), (61, "")]
    ids = {b"": 0, b"w0": 2, b"w1": 3, b"w3": 4}
    want: dict = {}
    for i, t in docs:
        if i % 5:
            row = [5, 5, *(ids.get(x, 1) for x in (t or "").encode().split()), 0]
            for u, v, w in zip(row, row[1:], row[2:], strict=False):
                want[v * 5 + w] = want.get(v * 5 + w, 0) + 1
                want[(6 + u) * 5 + w] = want.get((6 + u) * 5 + w, 0) + 1
    words = spark.sparkContext.broadcast((None, None, ids))
    for parts in (1, 7):
        df = spark.createDataFrame(docs, "id long, text string").repartition(parts)
        got = {}
        for r in lm.pairs(df, words, 5, lambda i: i % 5 != 0, 3).collect():
            got |= dict(zip(np.frombuffer(r.keys, np.int64).tolist(), np.frombuffer(r.n, np.int64).tolist(), strict=True))
        assert got == want


def test_partitions_do_not_matter(spark):
    docs = [(i, " ".join(f"w{(i * j) % 31}" for j in range(1, 40))) for i in range(80)]
    scores = []
    for parts in (1, 6):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        scores.append({r.doc_id: r.score for r in lm.score(df, size=20).collect()})
    assert all(scores[0][i] == pytest.approx(x, rel=1e-4) for i, x in scores[1].items())
