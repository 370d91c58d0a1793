"""Text readers, numbered lines, tracks on disk, streams, errors, and what remains without the text operators."""

import gzip
import shutil
import subprocess
import sys

import pytest

from pyspark.sql import functions as F

from sitegrid.functions import scalars
from sitegrid.operators import select
from sitegrid.sources import text
from sitegrid.streaming import accumulate
from tests.conftest import ROOT

CASES = {
    "bits": (["", "0.5", "2", "abc", "0", "1"], "bit", [True, False, True, True, False, True]),
    "chars": (["a1", "0", "."], "ch", ["a", "0", "."]),
    "states": (["TssA", "", "."], "state", ["TssA", "NA", "."]),
    "betas": (["NA", "-0.3", "3e-2", "", "0.5", "1"], "beta", [None, None, pytest.approx(0.03), 0.0, 0.5, 1.0]),
    "ternary": (["0", "1", "x"], "bit", [False, True, None]),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_values(kind, spark, tmp_path):
    lines, column, want = CASES[kind]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    assert [r[column] for r in text.read(spark, f"file://{tmp_path}/x.txt", kind, "s").orderBy("row_id").collect()] == want


def test_pairs_and_coordinates(spark, tmp_path):
    with gzip.open(tmp_path / "x.gz", "wt") as f:
        f.write("12\t3\n0\t0")
    assert [(r.m, r.u) for r in text.read(spark, f"file://{tmp_path}/x.gz", "mu").orderBy("row_id").collect()] == [(12, 3), (0, 0)]
    (tmp_path / "su").write_text("1\t1\n0\t1\n1\t0\n2\t7\n")
    assert [(r.in_set, r.in_uni) for r in text.read(spark, f"file://{tmp_path}/su", "su").orderBy("row_id").collect()] == [(True, True), (False, True), (True, False), (False, True)]
    (tmp_path / "bed").write_text("chr1\t100\t102\tx\nchr2\t7\t9\n")
    assert [(r.chrom, r.beg1) for r in text.read(spark, f"file://{tmp_path}/bed", "sites").orderBy("row_id").collect()] == [("chr1", 101), ("chr2", 8)]
    (tmp_path / "bad").write_text("1\tx\n")
    with pytest.raises(Exception, match="no count in"):
        text.read(spark, f"file://{tmp_path}/bad", "mu").collect()
    with pytest.raises(ValueError):
        text.columns("nothing")


def test_lines_are_numbered_over_partitions(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}").write_text("".join(f"{i}-{j}\n" for j in range(50 + i)))
    d = text.numbered(spark.read.text(f"file://{tmp_path}").repartition(5))
    assert sorted(r.row_id for r in d.collect()) == list(range(153))
    assert {r.block for r in text.line_blocks(d, 51).collect()} == {0, 1, 2}


def test_written_tracks_and_a_stream_of_them(spark, tmp_path):
    rows = [(s, i, i % 3, i % 2) for s in ("a", "b") for i in range(10)]
    d = spark.createDataFrame(rows, "sample string, row_id bigint, m bigint, u bigint")
    text.write(d, f"file://{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").select(*d.columns).collect())) == sorted(rows)
    d.where("sample = 'a'").write.parquet(f"file://{tmp_path}/in/1")
    d.where("sample = 'b'").write.parquet(f"file://{tmp_path}/in/2")
    q = accumulate.running_sum(accumulate.arriving(spark, f"file://{tmp_path}/in/*")).writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select row_id, m, u, n from sums").collect())) == [(i, 2 * (i % 3), 2 * (i % 2), 2 * (i % 3 + i % 2 > 0)) for i in range(10)]


def test_errors(spark):
    d = spark.createDataFrame([("a", 0, 1, 1)], "sample string, row_id bigint, m bigint, u bigint")
    sites = spark.createDataFrame([(0, "chr_1", 5)], "row_id bigint, chrom string, beg1 bigint")
    with pytest.raises(ValueError):
        select.subset(d, select.index(d), ["b"])
    with pytest.raises(ValueError):
        select.rows_by_name(d, sites, ["chr_1_6"])
    assert select.rows_by_name(d, sites, ["chr_1_5", "chr_1_5"]).count() == 2
    with pytest.raises(ValueError):
        select.append_index(select.index(d), "a")
    with pytest.raises(ValueError):
        select.require_axis(d, 2)
    with pytest.raises(ValueError):
        select.region(sites, "chr1:9-3")
    with pytest.raises(ValueError):
        select.mask(d, "states", d)


def test_counts_are_halved_together(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(0, 0), (2, 2), (3, 1), (300, 7), (2**40, 5)], "m bigint, u bigint")
    got = [(r.x.m, r.x.u) for r in d.select(scalars.fit_mu(F.col("m"), F.col("u"), 2).alias("x")).collect()]

    def plain(m, u):
        while max(m, u) >= 3:
            m, u = m // 2, u // 2
        return m, u

    assert got == [plain(r.m, r.u) for r in d.collect()]


def test_without_the_text_operators(tmp_path):
    """The rest imports and lists its queries when that subpackage and the pipeline are gone."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'summary_mu_states' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "r"), "HOME": "/root"})


def test_names_keep_their_order(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    assert [(r.sample, r.ord) for r in select.index(d, ["b", "a"]).orderBy("ord").collect()] == [("b", 0), ("a", 1), ("Unnamed_3", 2)]
    for names in (["a", "a"], ["a", "b", "c", "d"]):
        with pytest.raises(ValueError):
            select.index(d, names)


def test_a_missing_state_is_an_error(spark):
    d = spark.createDataFrame([(0, "x")], "row_id bigint, state string")
    with pytest.raises(ValueError):
        select.subset_states(d, ["x", "y"])


def test_runs_and_sums_across_blocks(spark):
    from sitegrid.operators import blocks, render

    chroms = ["a"] * 5 + ["b"] * 9 + ["a"] * 3 + [None] * 2 + ["a"]
    rows = [(i, c) for i, c in enumerate(chroms) if i not in (6, 7, 8)]
    d = spark.createDataFrame(rows, "row_id bigint, chrom string")
    plain, run = [], 0
    for n, (i, c) in enumerate(rows):
        run += n == 0 or rows[n - 1][1] != c
        plain.append((i, run))
    for size in (2, 3, 100):
        assert [(r.row_id, r.run) for r in blocks.runs(d, "chrom", size).orderBy("row_id").collect()] == plain
        assert [r.n for r in blocks.running(d, F.lit(1), "n", size).orderBy("row_id").collect()] == list(range(1, len(rows) + 1))
    assert sorted((r.first_row, r.chrom, r.n) for r in render.chrom_runs(d).collect()) == [(0, "a", 5), (5, "b", 6), (14, "a", 3), (17, None, 2), (19, "a", 1)]
