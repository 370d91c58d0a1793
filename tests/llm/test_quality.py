import numpy as np

from sitegrid.llm import quality
from sitegrid.llm.queries import queries
from tests.llm.brute import EDGE_TEXTS, crc


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / max(1, pos.sum() * (~pos).sum())


def test_held_out(spark):
    """At a scale with enough labels: documents never learned from are told apart, and good ones pass."""
    sf_dir = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries()["op4_quality"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and label.get(r.doc_id) is not None]
    score, y = (np.array(x) for x in zip(*held, strict=True))
    print("auc", auc(score, y), "passes", (score[y == 1] >= 0.3).mean(), "rejected", (score[y == 0] < 0.3).mean())
    assert auc(score, y) > 0.9
    assert (score[y == 1] >= 0.3).mean() > 0.95
    assert (score[y == 0] < 0.3).mean() > 0.5


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 5) = 0 then 1 - quality else quality end as quality")
    assert sorted(quality.classify(docs, labels).collect()) == sorted(quality.classify(docs, other).collect())


def test_edges(spark, sf_dir):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 0), (9999, 1)], "doc_id long, quality int")
    rows = [(i, t, "x", 0.5) for i, t in enumerate(EDGE_TEXTS)] + [(4, "word", None, None), (None, "word", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, score double")
    out = quality.classify(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1)}) == 1
    assert quality.classify(df.limit(0), labels).collect() == []
    assert quality.classify(df, labels.limit(0)).count() == len(rows)
    kept = quality.accepted(df, quality.train(df, labels), 0.0)
    assert kept.schema == df.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))


def test_risk_stays_non_negative():
    """Few positives among many unlabelled of two kinds: the model finds the positives' kind without overfitting them."""
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 1, (2000, 20)), r.normal(-1, 1, (1000, 20))
    m = quality.Model(good[:100], np.vstack([good[100:], bad]))
    assert 0.45 < m.prior < 0.85
    assert (m.score(good) >= 0.3).mean() > 0.95 and (m.score(bad) < 0.3).mean() > 0.9


def test_sums_over_a_table(spark):
    """Features added up by tasks give the model of the same features in one array, however they are divided."""
    r = np.random.default_rng(1)
    width = quality.KINDS * quality.KINDS + quality.EXTRA
    x = (r.random((600, width)) + np.repeat([0.0, 0.2], 300)[:, None]).astype(np.float32)
    plain = quality.Model(x[:60], x)
    df = spark.createDataFrame([(v.tobytes(),) for v in x], "x binary")
    for n in (1, 7):
        m = quality.Model(x[:60], quality._over(df.repartition(n)))
        assert m.prior == plain.prior and np.abs(m.weights - plain.weights).max() <= 2e-6


def test_smallest_hashes(spark):
    ids = spark.range(1000).unionAll(spark.range(500)).unionAll(spark.createDataFrame([(None,)], "id long"))
    by_hash = [r.id for r in spark.range(1000).selectExpr("id", "xxhash64(1, id) as h").orderBy("h").collect()]
    for n in (0, 1, 10, 999, 5000):
        assert quality._smallest(ids, n) == by_hash[:n]
    assert quality._smallest(ids.limit(0), 5) == []


def test_repeated_ids_by_their_own_texts(spark):
    """Rows of one id with other texts are unlabelled rows each; the order of rows changes nothing."""
    words = "the quick brown fox jumps over one lazy dog and runs home again".split()
    rows = [(i % 40, " ".join(words[j % len(words)] for j in range(i, i + 5 + i % 9)) if i % 3 else "!!! $$ 99 ## " * (i % 5 + 1)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id long, quality int")
    a, b = (quality.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1]))
    assert a.prior == b.prior and np.abs(a.weights - b.weights).max() <= 2e-6
