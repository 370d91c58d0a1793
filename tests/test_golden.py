"""The ten-row fixture: expected values were calculated by hand, apart from this code."""

import re

import pytest
from pyspark.sql import functions as F

from sitegrid.operators import enrich, render, rowop, sampling, select, summary
from tests.conftest import ROOT

MU = {"S1": [(12, 3), (8, 8), (0, 15), (20, 2), (0, 0), (5, 10), (1, 0), (0, 1), (2, 3), (0, 0)], "S2": [(6, 6), (0, 4), (3, 1), (0, 0), (9, 1), (2, 8), (0, 2), (4, 6), (1, 1), (0, 0)]}
SU = {"su": "11 01 11 00 01 11 10 00 01 11", "su_m": "11 11 01 11 00 10 01 11 00 11"}
BITS = {"q": "1011001010", "m": "1101000110"}


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    states = lambda n, s: make([(n, i, x) for i, x in enumerate(s)], "sample string, row_id bigint, state string")
    su = {k: make([(k, i, x[0] == "1", x[1] == "1") for i, x in enumerate(v.split())], "sample string, row_id bigint, in_set boolean, in_uni boolean") for k, v in SU.items()}
    at = [101, 106, 221, 301, 500, 51, 56, 90, 91, 200]
    return {
        "mu": make([(s, i, *x) for s, v in MU.items() for i, x in enumerate(v)], "sample string, row_id bigint, m bigint, u bigint"),
        "b": make([("b", i, x) for i, x in enumerate([0.75, 0.33, 0.88, None, 0.5, 0.92, 0.0, 1.0, None, 0.1])], "sample string, row_id bigint, beta double"),
        "st": states("st", "AABBBCCAAD"), "st2": states("st2", "XXXYYYYXXX"), **su,
        "sites": make([(i, "chr1" if i < 5 else "chr2", x) for i, x in enumerate(at)], "row_id bigint, chrom string, beg1 bigint"),
        **{k: make([(k, i, x == "1") for i, x in enumerate(v)], "sample string, row_id bigint, bit boolean") for k, v in BITS.items()},
    }


def expected() -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for line in (ROOT / "FIXTURES.md").read_text().splitlines():
        cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)[1:-1]]
        if len(cells) == 10 and cells[0].isdigit():
            out.setdefault(int(cells[0]), []).append((cells[1], cells[2].removesuffix(""), *map(int, cells[3:7]), *cells[7:]))
    return out


QUERY = {**dict.fromkeys(range(80, 84), ("q", "bits")), **dict.fromkeys(range(84, 88), ("st", "states")), **dict.fromkeys(range(88, 92), ("S1", "mu")), **dict.fromkeys(range(92, 96), ("b", "betas")), **dict.fromkeys(range(96, 100), ("su", "su")), **dict.fromkeys(range(100, 104), ("su", "su2bit"))}
MASK = {0: None, 1: ("m", "bits"), 2: ("st", "states"), 3: ("su", "su")}
ORDER = {80: 0, 81: 1, 82: 2, 83: 3, 84: 0, 85: 1, 86: 3, 87: 2, 88: 0, 89: 1, 90: 3, 91: 2, 92: 0, 93: 1, 94: 3, 95: 2, 96: 0, 97: 1, 98: 2, 99: 3, 100: 0, 101: 1, 102: 2, 103: 3}


def text(x, digits: int) -> str:
    return "NA" if x is None else {float("inf"): "inf", float("-inf"): "-inf"}.get(x) or f"{x:.{digits}f}".replace("-0.00", "0.00")


@pytest.mark.parametrize("op", sorted(ORDER))
def test_summary(op, t):
    name, kind = QUERY[op]
    q = t["mu"].where("sample = 'S1'") if name == "S1" else t[name]
    mask = MASK[ORDER[op]]
    if mask:
        mask = ("st2", "states") if op == 87 else ("su_m", "su") if mask[0] == "su" else mask
    got = summary.summary(q, kind, *((t[mask[0]], mask[1]) if mask else ())).collect()
    got = sorted((r["query"], r["mask"], r.n_univ, r.n_query, r.n_mask, r.n_overlap, text(r.log2_odds_ratio, 2), text(r.beta, 3), text(r.depth, 3)) for r in got)
    own = "su_m" if mask and mask[0] == "su_m" else None
    want = sorted((x[0], own if own and x[1] == "su" else x[1], *x[2:6], "NA" if x[6] == "neg" else x[6], *x[7:]) for x in expected()[op])
    assert got == want


def test_chromosomes(t):
    got = sorted((r["query"], r.n_univ, r.n_query) for r in summary.summary(t["sites"], "sites").collect())
    assert got == [("chr1", 10, 5), ("chr2", 10, 5)]


def pairs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("row_id").collect()]


def line(df):
    return "".join("." if not r.in_uni else str(int(r.in_set)) for r in df.orderBy("row_id").collect())


def test_across_samples(t):
    assert pairs(rowop.binasum(t["mu"], "mu"), "m", "u") == [(1, 0), (0, 1), (1, 1), (1, 0), (1, 0), (0, 2), (1, 1), (0, 1), (0, 0), (0, 0)]
    assert pairs(rowop.binasum(t["q"].union(t["m"]), "bits"), "m", "u") == [(2, 0), (1, 1), (1, 1), (2, 0), (0, 2), (0, 2), (1, 1), (1, 1), (2, 0), (0, 2)]
    assert pairs(rowop.musum(t["mu"]), "m", "u") == [(18, 9), (8, 12), (3, 16), (20, 2), (9, 1), (7, 18), (1, 2), (4, 7), (3, 4), (0, 0)]
    stat = [f"{r.n} {text(r.mean_beta, 3)} {text(r.sd_beta, 3)} {text(r.delta_beta, 3)} {r.min_n}" for r in rowop.stat(t["mu"]).orderBy("row_id").collect()]
    assert stat == ["2 0.650 0.150 NA 0", "2 0.250 0.250 NA 0", "2 0.375 0.375 0.750 1", "1 0.909 0.000 NA 0", "1 0.900 0.000 NA 0", "2 0.267 0.067 NA 0", "2 0.500 0.500 1.000 1", "2 0.200 0.200 NA 0", "2 0.450 0.050 NA 0", "0 NA NA NA 0"]
    assert pairs(rowop.binstring(t["mu"], select.index(t["mu"])), "bits") == [(x,) for x in ["10", "00", "01", "10", "01", "00", "10", "00", "00", "00"]]
    cells = {(r.row_id, r.k): f"{r.uu}-{r.um}-{r.mu}-{r.mm}" for r in rowop.cometh(t["mu"], 2).collect()}
    assert [cells[i, 1] for i in range(10)] == ["0-0-1-1", "0-1-1-0", "0-1-0-0", "0-0-0-0", "0-0-1-0", "1-1-0-0", "1-0-1-0", "1-1-0-0", "0-0-0-0", "0-0-0-0"]
    assert [cells[i, 2] for i in range(10)] == ["0-0-1-1", "0-0-0-1", "0-0-0-1", "0-0-1-0", "0-0-1-0", "2-0-0-0", "0-1-1-0", "0-0-0-0", "0-0-0-0", "0-0-0-0"]


@pytest.mark.parametrize("h, d, want", [(1, -1, "110..1100."), (1, 0.3, "110..0100."), (2, -1, "001..0011."), (2, 0.3, "001..0010."), (3, -1, "111..1111."), (3, 0.3, "111..0110.")])
def test_pairwise(t, h, d, want):
    assert line(rowop.pairwise(t["mu"], "S1", "S2", h, d)) == want


def test_masks_and_casts(t):
    s1 = t["mu"].where("sample = 'S1'")
    assert [line(select.binarize(s1, *x)) for x in ((0.5, 1), (0.5, 5), (0.5, 1, 5))] == ["1101.0100.", "1101.0..0.", "1101.1000."]
    assert pairs(select.mask(s1, "mu", t["m"]), "m", "u") == [(0, 0), (0, 0), (0, 15), (0, 0), (0, 0), (5, 10), (1, 0), (0, 0), (0, 0), (0, 0)]
    assert "".join(str(int(r.bit)) for r in select.mask(t["q"], "bits", t["m"]).orderBy("row_id").collect()) == "0010001000"
    assert line(select.mask(t["q"], "bits", t["m"], contextualize=True)) == "10.1...01."
    assert line(select.mask(t["su"], "su", t["m"])) == "10......0."


def test_views(t):
    s1 = t["mu"].where("sample = 'S1'")
    column = lambda df, kind, s, n: [r[s] for r in render.unpack(df, kind, [s], n).orderBy("row_id").collect()]
    assert column(s1, "mu", "S1", 0) == [str(x) for x in [51539607555, 34359738376, 15, 85899345922, 0, 21474836490, 4294967296, 1, 8589934595, 0]]
    assert column(s1, "mu", "S1", 10) == ["0.800", "0.500", "0.000", "0.909", "NA", "0.333", "NA", "NA", "NA", "NA"]
    assert "".join(column(t["su"], "su", "su", 0)) == "1012012201" and "".join(column(t["su"], "su", "su", 1)) == "3230231023"
    view = render.genome_view(s1, "mu", t["sites"], 4).orderBy("chrom").collect()
    assert [r.line for r in view] == ["MH", "MM"]


def test_enrichment(spark):
    r = enrich.enrich(spark.createDataFrame([(10, 5, 5, 3), (29401795, 2164614, 13795438, 757360)], "nu bigint, nd bigint, nq bigint, ndq bigint")).orderBy("nu").collect()
    assert (r[0].p_greater, r[0].p_less) == (pytest.approx(0.5), pytest.approx(0.8968253968253969))
    assert [r[1].log2_or, r[1].jaccard, r[1].overlap, r[1].npmi, r[1].dice] == pytest.approx([-0.7707630346418843, 0.049817492849292745, 0.34988224228430564, -0.08019761786610258, 0.09490695894975781])


def test_sampling(t):
    on = lambda df: {(r.sample, r.row_id): (r.m, r.u) for r in df.where("m + u > 0").collect()}
    full = on(t["mu"])
    for n in (0, 1, 5, 8, 99):
        kept = on(sampling.dsample(t["mu"], "mu", n))
        assert kept.items() <= full.items()
        assert all(sum(k[0] == s for k in kept) == min(n, sum(k[0] == s for k in full)) for s in MU)
    one = sampling.dsample(t["mu"], "mu", 4, seed=3)
    assert sorted(one.collect()) == sorted(sampling.dsample(t["mu"].repartition(7), "mu", 4, seed=3).collect())
    assert set(on(sampling.dsample(t["mu"], "mu", 4, to_binary=True)).values()) <= {(1, 0), (0, 1)}
    names = {r.sample for r in sampling.dsample(t["mu"], "mu", 1, repeats=2, prefix="x").select("sample").distinct().collect()}
    assert names == {"S1-x-0", "S1-x-1", "S2-x-0", "S2-x-1"}
    assert sorted(sampling.perturb(t["q"], "bits", 0.0).collect()) == sorted(t["q"].collect())
    flipped = sampling.perturb(t["su"], "su", 1.0).join(t["su"].select("row_id", F.col("in_set").alias("was")), "row_id").collect()
    assert all((r.in_set != r.was) == r.in_uni for r in flipped)
    with pytest.raises(ValueError):
        sampling.perturb(t["q"], "bits", 1.5)
