"""Options, descriptions and errors of track operators on small tables."""

import pytest
from pyspark.sql import functions as F

from sitegrid.operators import enrich, render, select, summary

MU = [(s, i, i % 5, i % 3) for s in ("a", "b", "c") for i in range(10)]


@pytest.fixture(scope="module")
def mu(spark):
    return spark.createDataFrame(MU, "sample string, row_id bigint, m bigint, u bigint")


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(i, "chr1", 10 * i + 1) for i in range(10)], "row_id bigint, chrom string, beg1 bigint")


def test_strict_axis(spark, mu):
    short = spark.range(9).selectExpr("'k' as sample", "id as row_id", "true as bit")
    for call in (lambda: select.mask(mu, "mu", short, strict=True), lambda: summary.summary(mu, "mu", short, "bits", strict=True), lambda: select.same_axis(mu, mu.where("sample <> 'a' or row_id > 0"))):
        with pytest.raises(ValueError, match="of 9 and of 10 rows"):
            call()
    select.same_axis(mu, mu.limit(0))
    assert select.mask(mu, "mu", short).count() == 27


def test_choose_rows(mu, sites):
    one = mu.where("sample = 'a'")
    by = sites.selectExpr("row_id", "row_id % 4 = 0 as bit")
    rows = lambda **how: [(r.row_id, r.m, r.u) for r in select.choose_rows(one, **how).orderBy("row_id").collect()]
    assert rows(names=["chr1_71", "chr1_1"], sites=sites, by=by, beg0=3) == [(0, 2, 1), (1, 0, 0)]
    assert rows(by=by, beg0=3, block=1) == [(0, 0, 0), (1, 4, 1), (2, 3, 2)]
    assert rows(beg0=3, block=0) == [(0, 3, 0)]
    assert rows(block=1, size=8) == [(0, 3, 2), (1, 4, 0)]
    assert rows() == [(0, 0, 0), (1, 1, 1)]
    for how in ({"names": ["chr1_71"]}, {"indices": [8]}):
        got = select.choose_rows(one, sites, coordinates=True, **how).collect()
        assert [(r.row_id, r.chrom, r.beg1) for r in got] == [(0, "chr1", 71)]
    with pytest.raises(ValueError, match="need sites"):
        select.choose_rows(one, coordinates=True)


def test_describe(spark, mu):
    index = select.index(mu)
    got = select.describe(mu, "mu", index, "x.cx").orderBy("sample").collect()
    assert [tuple(r) for r in got] == [("x.cx", s, "3", 10, "3", 1, "NA") for s in "abc"]
    with pytest.raises(Exception, match="not in the index: c"):
        select.describe(mu, "mu", index.where("sample <> 'c'")).collect()
    for keys, want in ((["x", "y", "x"], "N=2|x,y"), (["k" * 30, "z"], "N=2|" + "k" * 30 + ",..."), (["k" * 30], "N=1|" + "k" * 30), (["k" * 21, "z", "w"], "N=3|" + "k" * 21 + ",z,..."), (["b", "a"], "N=2|b,a")):
        t = spark.createDataFrame([("s", i, k) for i, k in enumerate(keys)], "sample string, row_id bigint, state string")
        r = select.describe(t, "states").first()
        assert (r["sample"], r.n_col, r.n_rows, r.keys) == ("1", "NA", len(keys), want)
    assert select.describe(mu.limit(0), "mu").collect() == []


def test_names(mu):
    index = select.index(mu)
    got = summary.summary(summary.renamed(mu, index, ["z", "y", "x", "w"]), "mu")
    assert {r["query"] for r in got.collect()} == {"z", "y", "x"}
    with pytest.raises(ValueError, match="2 names for 3 tracks"):
        summary.renamed(mu, index, ["z", "y"])


def test_unpack_chosen(mu):
    index = select.index(mu)
    columns = lambda **how: render.unpack_chosen(mu, "mu", index, **how).columns[1:]
    assert columns(names=["c", "a"], everything=True) == ["c", "a"]
    assert columns(everything=True, head=1) == ["a", "b", "c"]
    assert columns(head=2, tail=1) == ["a", "b"]
    assert columns(tail=2) == ["b", "c"]
    assert columns() == ["a"]
    with pytest.raises(ValueError, match="no sample q"):
        columns(names=["a", "q"])
    assert render.header(["a", "b"], 3) == "chrm\tbeg0\tend1\ta\tb" and render.header(["a"]) == "a"


def test_glyphs(spark):
    d = spark.createDataFrame([(0.0, "0", "L"), (0.5, "5", "M"), (1.0, "9", "H"), (None, ".", ".")], "beta double, tenth string, letter string")
    got = d.select("tenth", "letter", render.glyph("betas", True).alias("t"), render.glyph("betas").alias("l"), render.glyph("betas", True, True).alias("c")).collect()
    assert all(r.t == r.tenth and r.l == r.letter for r in got)
    assert [r.c for r in got] == ["\x1b[38;5;21m0\x1b[0m", "\x1b[38;5;231m5\x1b[0m", "\x1b[38;5;196m9\x1b[0m", "."]
    su = spark.createDataFrame([("s", 0, True, True), ("s", 1, False, True), ("s", 2, False, False), ("s", 3, True, True)], "sample string, row_id bigint, in_set boolean, in_uni boolean")
    assert [tuple(r) for r in render.dump(su).collect()] == [("s", 0, "1021")]
    assert [r.line for r in render.lines(su, render.glyph("su"), 2).orderBy("block").collect()] == ["█░", ".█"]


def test_tables(spark, tmp_path):
    (tmp_path / "t").write_text("100\t20\t30\t10\tname\tmore\n100\t20\t30\t0\n")
    got = enrich.enrich_file(spark, str(tmp_path / "t")).orderBy(F.desc("ndq")).collect()
    assert [(r.ndq, r.rest) for r in got] == [(10, "name\tmore"), (0, None)] and got[0].jaccard == 0.25
    (tmp_path / "bad").write_text("100\t20\t30\n")
    with pytest.raises(Exception, match="not four counts"):
        enrich.enrich_file(spark, str(tmp_path / "bad")).collect()
