"""Near-duplicate texts and vectors, and nearest neighbours, against all pairs."""

import numpy as np
import pytest

from sitegrid.llm import ann, ego, minhash
from sitegrid.llm.components import components
from sitegrid.llm.queries import queries
from tests.llm import brute
from tests.llm.brute import EDGE_TEXTS

VECTORS = "vec_id long, embedding array<float>, label int, rep long, key string"


def test_whole_table_of_texts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries()["op10_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute.near_duplicates(docs, 2)


@pytest.mark.parametrize("k", [2, 5])
def test_families_of_copies(spark, k):
    r = np.random.default_rng(k)
    docs, i = [], 0
    for _ in range(12):
        base = [f"w{x}" for x in r.integers(0, 400, r.integers(3, 200))]
        for _ in range(r.integers(1, 25)):
            w = list(base)
            for _ in range(r.integers(0, max(1, len(w) // 12))):
                w[r.integers(len(w))] = f"w{r.integers(0, 400)}"
            docs.append((i := i + 1, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k).collect()}
    assert got == brute.near_duplicates(docs, k)


def test_edges_of_texts(spark):
    """Null and blank texts link with nothing; equal rows are a group; a null id is kept and has no component."""
    docs = list(enumerate(EDGE_TEXTS))
    rows = [(i, t, i, "x", i) for i, t in docs] + [(4, "word", 0, None, 1), (None, "word", 0, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, key string, id long")
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got.pop(None) == (1, None, True)
    assert got == brute.near_duplicates(docs, 5)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [tuple(map(int, r.integers(500, 700, 2))) for _ in range(120)] + [(7, 7)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.find_root(links, {i for x in links if x[0] != x[1] for i in x})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vector_rows():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(30):
        center = r.normal(size=12)
        for _ in range(r.integers(1, 20)):
            rows.append((len(rows), (center + r.normal(size=12) * 0.12).astype(np.float32).tolist(), int(r.integers(0, 3)) if r.random() < 0.95 else None, len(rows), "x"))
    rows += [(len(rows) + i, rows[i % 9][1], rows[i % 9][2], 0, "x") for i in range(60)]
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [1.0, 2.0], [3e38] * 12, [3e38] * 12, [1e-40] * 12, [-0.0] * 12, [-0.0] + [1.0] * 11, [0.0] + [1.0] * 11]
    return rows + [(1000 + 20 * i, v, 1, 1, "y") for i, v in enumerate(bad)]


def test_whole_table_of_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries()["op6_near_vectors"](spark, sf_dir).collect()}
    assert got == brute.near_vectors(rows)


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_edges_of_vectors(spark, threshold):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego.near_vectors(df, threshold, leaf=16, fan=2).collect()}
    assert got == brute.near_vectors([x[:3] for x in rows], threshold)
    assert ego.near_vectors(df.limit(0)).collect() == []


def test_vectors_with_null_and_repeated_ids(spark):
    """A null id is kept, has no component and isn't counted by others; repeated rows are one id."""
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1, 0, ""), (5, v, 1, 0, ""), (5, v, 1, 0, ""), (6, v, 1, 0, "")], VECTORS)
    out = sorted(map(tuple, ego.near_vectors(df).collect()), key=repr)
    assert out == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 0, None, True)]


def recall(got, want) -> float:
    hit = total = 0
    for q, best in want.items():
        ids = {i for i, _ in got.get(q, [])}
        worst = min((s for _, s in best), default=0)
        total += len(best)
        hit += sum(1 for i, s in got.get(q, []) if s >= worst - 1e-12)
        assert len(ids) == len(got.get(q, []))
    return hit / total


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_nearest_on_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    exact = dict(rows)
    got = answers(queries()["op9_nearest"](spark, sf_dir))
    want = brute.nearest(rows)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            assert abs(s - float(np.dot(np.array(exact[q], float), np.array(exact[i], float)))) < 1e-9
    assert recall(got, want) >= 0.9


def test_edges_of_nearest(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    got = answers(ann.nearest(df, df.where("vec_id % 20 = 0")))
    want = brute.nearest([x[:2] for x in rows])
    assert {q for q, w in want.items() if w} == got.keys()
    assert recall(got, {q: w for q, w in want.items() if w}) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_nearest_of_many_equal_vectors(spark):
    """Ties go to smaller ids; a query never finds its own id; null and repeated ids don't count."""
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, v, 1, 0, "") for i in [*range(100), 7, None]], VECTORS)
    got = answers(ann.nearest(df, df.where("vec_id % 20 = 0")))
    for q in range(0, 100, 20):
        assert [i for i, _ in got[q]] == [i for i in range(21) if i != q][:20]
