"""Mixing and line dedup: native operators, against DuckDB and plain versions."""

from collections import defaultdict

import pytest

from sitegrid.llm import line_dedup, mixing
from sitegrid.llm.queries import oracle_sql, queries
from tests.conftest import same
from tests.llm import brute
from tests.llm.brute import EDGE_TEXTS


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_mix"])
def test_against_sql(name, spark, sf_dir, duck):
    same(queries()[name](spark, sf_dir), duck, oracle_sql()[name])


def check_mix(rows, docs):
    size = {i: len(brute.words(t)) for i, t, _ in docs}
    of = defaultdict(int)
    for i, _, s in docs:
        of[s] += size[i]
    want, taken = brute.mix_targets(dict(of)), defaultdict(int)
    for r in rows:
        s = next(s for i, _, s in docs if i == r.doc_id)
        assert (r.size, r.source_size) == (size[r.doc_id], of[s])
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(128, 0.02 * t), s


def test_mix_of_the_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    one = queries()["op7_mix"](spark, sf_dir).collect()
    assert len(one) == len(docs)
    check_mix(one, docs)
    assert sorted(one) == sorted(queries()["op7_mix"](spark, sf_dir).collect())


def test_mix_edges(spark):
    docs = [(i, t, ["a", "b", None, "", "é"][i % 5]) for i, t in enumerate(EDGE_TEXTS)] + [(1000 + i, "w " * (i % 50), "big") for i in range(500)] + [(2000, None, "empty"), (2001, "", "empty")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, size long, place string, id long")
    out = mixing.mix(df).collect()
    assert len(out) == len(docs)
    check_mix(out, docs)
    assert mixing.mix(df.limit(0)).collect() == []
    twice = mixing.mix(df.union(df).union(spark.createDataFrame([(None, "one two", "a", 1, "x", 2)], df.schema)))
    assert twice.count() == 2 * len(docs) + 1


def test_mixed_rows(spark):
    """Every column stays, null ids and repeated rows too; a document comes as often as it is taken."""
    rows = [(i, "a b c d " * 30, "x" if i % 3 else "y", i) for i in range(300)] + [(None, "a b", "x", 1), (5, "a b c d " * 30, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m_id long")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    sizes = defaultdict(int)
    for r in out.collect():
        assert (r.doc_id, r.text, r.source, r.m_id) in rows
        sizes[r.source] += len(r.text.split())
    want = brute.mix_targets({s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in "xy"})
    for s in "xy":
        assert abs(sizes[s] - want[s]) < 0.15 * want[s]


def plain_lines(docs, sites=12):
    trim = lambda x: x.strip(" \t\r")
    on = defaultdict(set)
    for _, t, s in docs:
        for x in (t or "").split("\n"):
            if trim(x) and s is not None:
                on[trim(x)].add(s)
    common = {x for x, s in on.items() if len(s) >= sites}
    out = {}
    for i, t, _ in docs:
        lines = [] if t is None else t.split("\n")
        lost = [x for x in lines if trim(x) in common]
        cut = bool(lost) and any(trim(x) and trim(x) not in common for x in lines)
        out[i] = ("\n".join(x for x in lines if trim(x) not in common) if cut else t, len(lines), len(lost) if cut else 0)
    return out


def test_line_edges(spark):
    docs = [(i, t, f"s{i}") for i, t in enumerate(EDGE_TEXTS)]
    long = "\n".join(f"own line {j} of this text" for j in range(2000))
    for n in (11, 12, 13, 40):
        docs += [(1000 * n + i, f"body {n} {i} with enough of its own words here\n shared {n}\t\r\n\n{long if i == 0 else 'more own text ' + str(i)}", f"s{i}") for i in range(n)]
    docs += [(90_000 + i, "copied everywhere\nnearly all of it", f"s{i}") for i in range(30)] + [(95_000 + i, "one site only\nsome own words " + str(i), "s1") for i in range(30)] + [(96_000 + i, "no site\nsome own words " + str(i), None) for i in range(30)]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, source string, id long, h string, site string")
    for in_place in (10_000, 0):  # looked up where texts are read, and behind a Bloom filter
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(df, in_place=in_place).collect()}
        assert got == plain_lines(docs)
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_lines_of_a_null_id(spark):
    """Documents without an id are cut like others."""
    docs = [(i, f"own words of document {i}\nshared", f"s{i}") for i in range(20)]
    df = spark.createDataFrame([*docs, (None, "own words here\nshared", "s1"), docs[0]], "doc_id long, text string, source string")
    out = line_dedup.line_dedup(df).collect()
    assert len(out) == 22
    assert all(r.n_removed == 1 and "shared" not in r.text for r in out)


def test_quotas_add_up(spark):
    """Seats by highest quotients, against a plain count one by one; alike parties, one giant, and none."""
    cases = {"alike": [10.4] * 50, "giant": [1000.0] + [0.4] * 40, "mixed": [0.0, 3.3, 7.7, 1.5, 1.5], "few": [0.02] * 100}
    rows, want = [], {}
    for g, shares in cases.items():
        house = round(sum(shares))
        got = [0] * len(shares)
        for _ in range(house):
            best = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        want[g] = got
        rows += [(g, i, x, house) for i, x in enumerate(shares)]
    df = spark.createDataFrame(rows, "g string, i long, share double, house long")
    found = {g: [0] * len(x) for g, x in cases.items()}
    for r in mixing.apportion(df, ["g"], ["i"], "seats").collect():
        found[r.g][r.i] = r.seats
    assert found == want


def test_alike_shards_meet_the_target(spark):
    docs = [(40 * j + i, " ".join(["word"] * 40), f"s{j:02d}") for j in range(40) for i in range(50)]
    df = spark.createDataFrame([(i * 1000 + n, t, s) for n, (i, t, s) in enumerate(docs)], "doc_id long, text string, source string")
    by: dict = {}
    for r in mixing.mix(df, shard_words=256).collect():
        goal, taken = by.get(r.source, (0, 0))
        by[r.source] = (r.target, taken + r.taken)
    assert all(abs(goal - taken) <= 2 * 64 for goal, taken in by.values())
