"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.functions import scalars
from sitegrid.operators import enrich, intervals, render, rowop, sampling, select, summary
from sitegrid.plans.bindings import track, with_views
from sitegrid.sources import text

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: What a column of a registered result is rounded to.
DIGITS = 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _add(name: str, make: Callable, *views: str, sql: str | None = None) -> None:
    """make(tracks..., spark) gives the result; sql reads views of the same names."""
    _Q[name] = lambda spark, sf_dir: _rounded(make(*(track(spark, sf_dir, v) for v in views), spark))
    if sql is not None:
        _SQL[name] = f"WITH {with_views(*views)}{sql}" if sql.startswith(",") else f"WITH {with_views(*views)} {sql}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# summaries -----------------------------------------------------------------------------------------------------------
_TRACK = {"bits": "bits", "states": "states", "mu": "mu", "betas": "beta_track", "su": "su", "su2bit": "su"}
_ON = {"bits": "q.bit", "mu": "q.m+q.u>0", "betas": "q.beta IS NOT NULL", "su": "q.in_set AND q.in_uni"}
_CODE = "CAST(q.in_set AS INT)+2*CAST(q.in_uni AS INT)"
_LOR = """CASE WHEN (nu-nq-nm+no)*no>0 AND (nq-no)*(nm-no)>0 THEN log2(CAST((nu-nq-nm+no)*no AS DOUBLE)/((nq-no)*(nm-no)))
 WHEN (nu-nq-nm+no)*no>0 AND (nq-no)*(nm-no)=0 THEN CAST('inf' AS DOUBLE) WHEN (nu-nq-nm+no)*no=0 AND (nq-no)*(nm-no)>0 THEN CAST('-inf' AS DOUBLE) END"""


def _summary_sql(q: str, m: str | None) -> str:
    """Kernel by kernel: the rows' counts nu, nq, nm, no, a level b and a depth sum sd, by query qn and mask mn."""
    mt = {"bits": "bits", "states": "brands" if q == "states" else "states", "su": "su"}.get(m)
    j = f"{_TRACK[q]} q" + (f" JOIN {mt} k ON k.row_id=q.row_id" if m else "")
    ms = "k.sample" if m else "'global'"
    mm = {"bits": "k.bit", "su": "k.in_set AND k.in_uni", "states": "TRUE", None: "TRUE"}[m]
    if q in _ON:
        on = _ON[q]
        w = " AND ".join([*(["q.in_uni"] if q == "su" else []), *(["k.in_uni"] if m == "su" and q in ("bits", "su") else [])]) or "TRUE"
        v = {"mu": "CASE WHEN q.m+q.u>0 THEN CAST(q.m AS DOUBLE)/(q.m+q.u) END", "betas": "q.beta"}.get(q, "0")
        d = "q.m+q.u" if q == "mu" else "1"
        key = "k.state" if m == "states" else "CAST(NULL AS VARCHAR)"
        g = f"SELECT q.sample AS qn, {ms} AS ms, {key} AS mk, sum(CASE WHEN {w} THEN 1 ELSE 0 END) AS u1, sum(CASE WHEN {w} AND {on} THEN 1 ELSE 0 END) AS q1, sum(CASE WHEN {w} AND {mm} THEN 1 ELSE 0 END) AS m1, sum(CASE WHEN {w} AND {on} AND {mm} THEN 1 ELSE 0 END) AS no, sum(CASE WHEN {w} AND {on} AND {mm} THEN {v} END) AS sv, sum(CASE WHEN {w} AND {mm} THEN {d} END) AS sd FROM {j} GROUP BY 1,2,3"
        nm = "0" if not m and q in ("mu", "betas") else "m1"
        b = {"bits": "0.0", "su": "CAST(nq AS DOUBLE)/nullif(nu,0)" if not m else "CAST(no AS DOUBLE)/nullif(nm,0)"}.get(q, "sv/nullif(no,0)")
        depth = "CASE WHEN sd>0 THEN CAST(sd AS DOUBLE)/(CASE WHEN nm>0 THEN nm ELSE nu END) END" if q == "mu" or q == "su" and not m else "CAST(NULL AS DOUBLE)"
        t = f"SELECT qn, coalesce(mk,ms) AS mn, sum(u1) OVER (PARTITION BY qn,ms) AS nu, sum(q1) OVER (PARTITION BY qn,ms) AS nq, {nm} AS nm, no, sv, sd FROM g"
    else:
        key = "q.state" if q == "states" else _CODE
        keys = f"SELECT DISTINCT sample AS qs, state AS qk FROM {_TRACK[q]}" if q == "states" else "SELECT s.qs, c.qk FROM (SELECT DISTINCT sample AS qs FROM su) s CROSS JOIN (SELECT unnest([0,1,2,3]) AS qk) c"
        mk = "k.state" if m == "states" else "CAST(NULL AS VARCHAR)"
        g = f"SELECT q.sample AS qs, {ms} AS ms, {key} AS qk, {mk} AS mk, count(*) AS n, sum(CASE WHEN {mm} THEN 1 ELSE 0 END) AS mq FROM {j} GROUP BY 1,2,3,4"
        qn = "f.qs||'|'||f.qk" if q == "su2bit" else ("f.qs||'-'||f.qk" if m in ("bits", "su") else "f.qk")
        mn = "f.mk" if m == "states" else ("f.ms||'|1'" if q == "su2bit" and m else "f.ms")
        nm = {True: "nu0" if q == "su2bit" else "0", False: "sum(mq) OVER (PARTITION BY f.qs,f.ms,f.mk)"}[m is None]
        no = {True: "nq0" if q == "su2bit" else "0", False: "mq+1" if q == m else "mq"}[m is None]
        b = "1.0" if not m and q == "su2bit" else "CAST(no AS DOUBLE)/nullif(nm,0)" if q == "su2bit" and m == "states" else "0.0"
        depth = "CAST(NULL AS DOUBLE)"
        t = f"""SELECT {qn} AS qn, {mn} AS mn, nu0 AS nu, nq0 AS nq, {nm} AS nm, {no} AS no FROM (SELECT f.*, coalesce(g.n,0) AS n, coalesce(g.mq,0) AS mq, sum(coalesce(g.n,0)) OVER (PARTITION BY f.qs,f.ms) AS nu0, sum(coalesce(g.n,0)) OVER (PARTITION BY f.qs,f.ms,f.qk) AS nq0
 FROM (SELECT k.qs, k.qk, h.ms, h.mk FROM ({keys}) k JOIN (SELECT DISTINCT qs, ms, mk FROM g) h ON h.qs=k.qs) f LEFT JOIN g ON g.qs=f.qs AND g.ms=f.ms AND g.qk=f.qk AND g.mk IS NOT DISTINCT FROM f.mk) f"""
    odds = _LOR if m else "CAST(NULL AS DOUBLE)"
    return f", g AS ({g}), t AS ({t}) SELECT qn AS query, mn AS mask, CAST(nu AS BIGINT) AS n_univ, CAST(nq AS BIGINT) AS n_query, CAST(nm AS BIGINT) AS n_mask, CAST(no AS BIGINT) AS n_overlap, round({odds},{DIGITS}) AS log2_odds_ratio, round(CAST({b} AS DOUBLE),{DIGITS}) AS beta, round({depth},{DIGITS}) AS depth FROM t"


for _q in _TRACK:
    for _m in (None, "bits", "states", "su"):
        _mt = {"bits": "bits", "states": "brands" if _q == "states" else "states", "su": "su"}.get(_m)
        _views = (_TRACK[_q], _mt) if _mt else (_TRACK[_q],)
        _add(f"summary_{_q}_{_m or 'global'}", lambda *a, q=_q, m=_m: summary.summary(a[0], q, a[1] if m else None, m), *_views, sql=_summary_sql(_q, _m))
_add("summary_sites_global", lambda s, _: summary.summary(s, "sites"), "sites", sql="SELECT chrom AS query, 'global' AS mask, (SELECT count(*) FROM sites) AS n_univ, count(*) AS n_query, CAST(0 AS BIGINT) AS n_mask, CAST(0 AS BIGINT) AS n_overlap, CAST(NULL AS DOUBLE) AS log2_odds_ratio, CAST(NULL AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS depth FROM sites GROUP BY chrom")

# values, masks, comparisons ------------------------------------------------------------------------------------------
_add("beta_cov", lambda d, _: d.select("sample", "row_id", scalars.beta(F.col("m"), F.col("u")).alias("beta"), scalars.cov(F.col("m"), F.col("u")).alias("cov")), "mu", sql="SELECT sample, row_id, round(CAST(m AS DOUBLE)/nullif(m+u,0),6) AS beta, m+u AS cov FROM mu")
_add("fit_mu_2", lambda d, _: d.select("sample", "row_id", scalars.fit_mu(F.col("m"), F.col("u"), 2).alias("x")).select("sample", "row_id", "x.m", "x.u"), "mu", sql="SELECT sample, row_id, CASE WHEN greatest(m,u)<3 THEN m WHEN greatest(m,u)<6 THEN m//2 WHEN greatest(m,u)<12 THEN m//4 ELSE m//8 END AS m, CASE WHEN greatest(m,u)<3 THEN u WHEN greatest(m,u)<6 THEN u//2 WHEN greatest(m,u)<12 THEN u//4 ELSE u//8 END AS u FROM mu")
_add("symbols", lambda d, _: d.select("sample", "row_id", scalars.level(F.col("beta")).alias("glyph"), scalars.decile(F.col("beta")).alias("decile")), "beta_track", sql="SELECT sample, row_id, CASE WHEN beta>0.67 THEN 'H' WHEN beta>0.33 THEN 'M' WHEN beta IS NOT NULL THEN 'L' ELSE '.' END AS glyph, CAST(least(9,floor(beta*10)) AS INT) AS decile FROM beta_track")
_add("binarize_beta", lambda d, _: select.binarize(d, 0.5, 2), "mu", sql="SELECT sample, row_id, m+u>=2 AND coalesce(CAST(m AS DOUBLE)/nullif(m+u,0)>=0.5,false) AS in_set, m+u>=2 AS in_uni FROM mu")
_add("binarize_m", lambda d, _: select.binarize(d, min_cov=1, min_m=3), "mu", sql="SELECT sample, row_id, m+u>=1 AND m>=3 AS in_set, m+u>=1 AS in_uni FROM mu")
_add("cast_mu_bits", lambda d, _: select.to_bits(d, "mu"), "mu", sql="SELECT sample, row_id, m+u>0 AS bit FROM mu")
for _name, _inv, _ctx in (("mask_{}", False, False), ("mask_inv_{}", True, False)):
    _n = "NOT " if _inv else ""
    _by = lambda b: b.where("sample = 'mod3'")
    _add(_name.format("mu"), lambda d, b, _, i=_inv: select.mask(d, "mu", _by(b), i), "mu", "bits", sql=f"SELECT q.sample, q.row_id, CASE WHEN {_n}k.bit THEN 0 ELSE m END AS m, CASE WHEN {_n}k.bit THEN 0 ELSE u END AS u FROM mu q JOIN bits k ON k.row_id=q.row_id AND k.sample='mod3'")
    _add(_name.format("su"), lambda d, b, _, i=_inv: select.mask(d, "su", _by(b), i), "su", "bits", sql=f"SELECT q.sample, q.row_id, in_set AND in_uni AND {_n}k.bit AS in_set, in_uni AND {_n}k.bit AS in_uni FROM su q JOIN bits k ON k.row_id=q.row_id AND k.sample='mod3'")
    _add(_name.format("bits"), lambda b, _, i=_inv: select.mask(b.where("sample = 'big'"), "bits", _by(b), i), "bits", sql=f"SELECT q.sample, q.row_id, q.bit AND NOT ({_n}k.bit) AS bit FROM bits q JOIN bits k ON k.row_id=q.row_id AND k.sample='mod3' WHERE q.sample='big'")
_add("mask_ctx", lambda b, _: select.mask(b.where("sample = 'big'"), "bits", _by(b), contextualize=True), "bits", sql="SELECT q.sample, q.row_id, q.bit AND k.bit AS in_set, k.bit AS in_uni FROM bits q JOIN bits k ON k.row_id=q.row_id AND k.sample='mod3' WHERE q.sample='big'")
_B = "SELECT a.row_id, CAST(a.m AS DOUBLE)/nullif(a.m+a.u,0) AS x, CAST(b.m AS DOUBLE)/nullif(b.m+b.u,0) AS y, a.m+a.u>=1 AND b.m+b.u>=1 AS uni FROM mu a JOIN mu b ON b.row_id=a.row_id AND a.sample='S1' AND b.sample='S2'"
for _h, _c in ((1, "x>y AND x-y>0.1"), (2, "y>x AND y-x>0.1"), (3, "abs(x-y)>0.1")):
    _add(f"pairwise_h{_h}", lambda d, _, h=_h: rowop.pairwise(d, "S1", "S2", h, 0.1), "mu", sql=f", b AS ({_B}) SELECT row_id, coalesce(uni AND {_c},false) AS in_set, uni AS in_uni FROM b")
_add("pairwise_strict", lambda d, _: rowop.pairwise(d, "S1", "S2", 3), "mu", sql=f", b AS ({_B}) SELECT row_id, coalesce(uni AND x<>y,false) AS in_set, uni AS in_uni FROM b")

# rows and samples ----------------------------------------------------------------------------------------------------
_IDX = [5, 3, 3, 120, 1]
_add("rowsub_idx", lambda d, _: select.rows_by_index(d, _IDX), "mu", sql=f"SELECT sample, p.place AS row_id, m, u FROM mu JOIN (SELECT unnest({_IDX})-1 AS r, CAST(unnest(range({len(_IDX)})) AS BIGINT) AS place) p ON p.r=mu.row_id")
_add("rowsub_coord", lambda d, s, _: select.rows_by_name(d, s, [f"{r.chrom}_{r.beg1}" for r in s.where("row_id in (9, 2, 150)").orderBy(F.desc("row_id")).collect()]), "mu", "sites", sql="SELECT sample, CASE mu.row_id WHEN 150 THEN CAST(0 AS BIGINT) WHEN 9 THEN 1 ELSE 2 END AS row_id, m, u FROM mu JOIN sites USING (row_id) WHERE mu.row_id IN (9,2,150)")
_add("rowsub_mask", lambda d, b, _: select.rows_by_mask(d, _by(b)), "mu", "bits", sql=", o AS (SELECT row_id, row_number() OVER (ORDER BY row_id)-1 AS n FROM bits WHERE sample='mod3' AND bit) SELECT sample, n AS row_id, m, u FROM mu JOIN o USING (row_id)")
_add("rowsub_range", lambda d, _: select.rows_between(d, 10, 60), "mu", sql="SELECT sample, row_id-10 AS row_id, m, u FROM mu WHERE row_id BETWEEN 10 AND 59")
_add("rowsub_block", lambda d, _: select.row_block(d, 1, 64), "mu", sql="SELECT sample, row_id-64 AS row_id, m, u FROM mu WHERE row_id BETWEEN 64 AND 127")
_add("rowsub_default", lambda d, _: select.rows_between(d), "mu", sql="SELECT sample, row_id, m, u FROM mu WHERE row_id<=1")
_add("region", lambda s, _: select.region(s, "chr2:10,000-200,000"), "sites", sql="SELECT * FROM sites WHERE chrom='chr2' AND beg1 BETWEEN 10000 AND 200000")
_add("subset_names", lambda d, _: select.subset(d, select.index(d), ["S3", "S1"]).select("sample", "row_id", "m", "u", "ord"), "mu", sql="SELECT sample, row_id, m, u, CASE sample WHEN 'S3' THEN CAST(0 AS BIGINT) ELSE 1 END AS ord FROM mu WHERE sample IN ('S3','S1')")
_add("subset_head", lambda d, _: select.subset(d, select.index(d), head=2).select("sample", "row_id", "m", "u"), "mu", sql="SELECT sample, row_id, m, u FROM mu WHERE sample IN ('S1','S2')")
_add("subset_tail", lambda d, _: select.subset(d, select.index(d), tail=2).select("sample", "row_id", "m", "u"), "mu", sql="SELECT sample, row_id, m, u FROM mu WHERE sample IN ('S6','S7')")
_add("subset_states", lambda d, _: select.subset_states(d, ["ECONOMY", "PROMO"]), "states", sql="SELECT t AS sample, row_id, state=t AS bit FROM states CROSS JOIN (SELECT unnest(['ECONOMY','PROMO']) AS t)")
_add("index", lambda d, _: select.index(d), "mu", sql="SELECT sample, row_number() OVER (ORDER BY sample)-1 AS ord FROM (SELECT DISTINCT sample FROM mu)")
_add("info", lambda d, s, _: select.info(d, "mu").union(select.info(s, "states")), "mu", "states", sql="SELECT sample, count(*) AS n_rows, 'mu' AS format, CAST(NULL AS BIGINT) AS n_keys FROM mu GROUP BY 1 UNION ALL SELECT sample, count(*), 'states', count(DISTINCT state) FROM states GROUP BY 1")
_add("state_keys", lambda d, _: select.state_keys(d), "states", sql="SELECT state, min(row_id) AS first_row, count(*) AS n FROM states GROUP BY 1")
_add("chunk_map", lambda d, _: select.chunk(d, 50).groupBy("sample", "chunk").agg(F.count("*").alias("n"), F.sum("m").alias("m")), "mu", sql="SELECT sample, row_id//50 AS chunk, count(*) AS n, CAST(sum(m) AS BIGINT) AS m FROM mu GROUP BY 1,2")
_add("union_tracks", lambda b, s, _: b.unionByName(select.subset_states(s, ["ECONOMY"])), "bits", "states", sql="SELECT sample, row_id, bit FROM bits UNION ALL SELECT 'ECONOMY', row_id, state='ECONOMY' FROM states")

# across samples ------------------------------------------------------------------------------------------------------
_add("rowop_binasum_bits", lambda d, _: rowop.binasum(d, "bits"), "bits", sql="SELECT row_id, count(*) FILTER (bit) AS m, count(*) FILTER (NOT bit) AS u FROM bits GROUP BY 1")
_MB = ", b AS (SELECT *, CAST(m AS DOUBLE)/nullif(m+u,0) AS b FROM mu)"
_add("rowop_binasum_mu", lambda d, _: rowop.binasum(d, "mu", min_cov=2), "mu", sql=_MB + " SELECT row_id, count(*) FILTER (b>0.6 AND m+u>=2) AS m, count(*) FILTER (b<0.4 AND m+u>=2) AS u FROM b GROUP BY 1")
_add("rowop_musum", lambda d, _: rowop.musum(d), "mu", sql="SELECT row_id, CAST(sum(m) AS BIGINT) AS m, CAST(sum(u) AS BIGINT) AS u FROM mu GROUP BY 1")
_add("rowop_stat", lambda d, _: rowop.stat(d), "mu", sql=_MB + " SELECT row_id, count(b) AS n, round(avg(b),6) AS mean_beta, round(stddev_pop(b),6) AS sd_beta, round(min(b) FILTER (b>0.5)-max(b) FILTER (b<0.5),6) AS delta_beta, least(count(*) FILTER (b>0.5),count(*) FILTER (b<0.5)) AS min_n FROM b GROUP BY 1")
_add("rowop_mean", lambda d, _: rowop.stat(d).select("row_id", "mean_beta"), "mu", sql=_MB + " SELECT row_id, round(avg(b),6) AS mean_beta FROM b GROUP BY 1")
_add("rowop_std", lambda d, _: rowop.stat(d).select("row_id", "sd_beta"), "mu", sql=_MB + " SELECT row_id, round(stddev_pop(b),6) AS sd_beta FROM b GROUP BY 1")
_add("rowop_binstring", lambda d, _: rowop.binstring(d, select.index(d)), "mu", sql=_MB + " SELECT row_id, string_agg(CASE WHEN b>0.5 THEN '1' ELSE '0' END, '' ORDER BY sample) AS bits FROM b GROUP BY 1")
_add("rowop_cometh", lambda d, _: rowop.cometh(d, 3), "mu", sql=", d AS (SELECT sample, row_id, m>=u AS a FROM mu WHERE m+u>0), p AS (SELECT x.row_id, y.row_id-x.row_id AS k, x.a, y.a AS b FROM d x JOIN d y ON y.sample=x.sample AND y.row_id BETWEEN x.row_id+1 AND x.row_id+3), c AS (SELECT row_id, k, count(*) FILTER (NOT a AND NOT b) AS uu, count(*) FILTER (NOT a AND b) AS um, count(*) FILTER (a AND NOT b) AS mu, count(*) FILTER (a AND b) AS mm FROM p GROUP BY 1,2), r AS (SELECT row_id, unnest([CAST(1 AS BIGINT),2,3]) AS k FROM (SELECT DISTINCT row_id FROM mu)) SELECT r.row_id, CAST(r.k AS INT) AS k, CASE WHEN f THEN coalesce(uu,0) ELSE 0 END AS uu, CASE WHEN f THEN coalesce(um,0) ELSE 0 END AS um, CASE WHEN f THEN coalesce(c.mu,0) ELSE 0 END AS mu, CASE WHEN f THEN coalesce(mm,0) ELSE 0 END AS mm FROM (SELECT *, row_id+3<=(SELECT max(row_id) FROM mu) AS f FROM r) r LEFT JOIN c ON c.row_id=r.row_id AND c.k=r.k")

# intervals, views, statistics ----------------------------------------------------------------------------------------
_OV = "LEFT JOIN intervals i ON i.chrom=s.chrom AND s.beg1-1<i.end0 AND s.beg1+1>i.beg0"
_add("interval_count", lambda s, i, _: intervals.count_overlaps(s, i), "sites", "intervals", sql=f"SELECT s.row_id, count(i.name) AS n FROM sites s {_OV} GROUP BY 1")
_add("interval_label", lambda s, i, _: intervals.label(s, i), "sites", "intervals", sql=f"SELECT s.row_id, coalesce(arg_min(i.name, (i.beg0,i.end0,i.name)),'.') AS state FROM sites s {_OV} GROUP BY 1")
_add("interval_align", lambda s, d, _: intervals.align(s, d.where("sample = 'S1' and m > 0").join(s, "row_id").select("chrom", "beg1", "m", "u")), "sites", "mu", sql="SELECT s.row_id, coalesce(c.m,0) AS m, coalesce(c.u,0) AS u FROM sites s LEFT JOIN (SELECT chrom, beg1, m, u FROM mu JOIN sites USING (row_id) WHERE sample='S1' AND m>0) c ON c.chrom=s.chrom AND c.beg1=s.beg1")
_add("interval_windows", lambda s, _: intervals.windows(s), "sites", sql="SELECT row_id, chrom||':'||((beg1-1)//100000*100000)||'-'||((beg1-1)//100000*100000+100000) AS state FROM sites")
_add("unpack_packed", lambda d, _: render.unpack(d, "mu", ["S1", "S2"]), "mu", sql="SELECT row_id, max(CAST(m*4294967296+u AS VARCHAR)) FILTER (sample='S1') AS \"S1\", max(CAST(m*4294967296+u AS VARCHAR)) FILTER (sample='S2') AS \"S2\" FROM mu GROUP BY 1")
_add("unpack_mu", lambda d, _: render.unpack(d, "mu", ["S1", "S2"], -1), "mu", sql="SELECT row_id, max(m||chr(9)||u) FILTER (sample='S1') AS \"S1\", max(m||chr(9)||u) FILTER (sample='S2') AS \"S2\" FROM mu GROUP BY 1")
_add("unpack_su", lambda d, _: render.unpack(d, "su", ["S1", "S2"], 1), "su", sql="SELECT row_id, max(CAST(CAST(in_set AS INT)+2*CAST(in_uni AS INT) AS VARCHAR)) FILTER (sample='S1') AS \"S1\", max(CAST(CAST(in_set AS INT)+2*CAST(in_uni AS INT) AS VARCHAR)) FILTER (sample='S2') AS \"S2\" FROM su GROUP BY 1")
_add("unpack_beta", lambda d, _: render.unpack(d, "mu", ["S1", "S2"], 2), "mu", sql=", t AS (SELECT row_id, sample, CASE WHEN m+u>=2 THEN printf('%.3f', round(CAST(m AS DOUBLE)/(m+u),3)) ELSE 'NA' END AS x FROM mu) SELECT row_id, max(x) FILTER (sample='S1') AS \"S1\", max(x) FILTER (sample='S2') AS \"S2\" FROM t GROUP BY 1")
_add("unpack_bits", lambda d, _: render.unpack(d, "bits", ["big", "mod3"]), "bits", sql="SELECT row_id, max(CAST(CAST(bit AS INT) AS VARCHAR)) FILTER (sample='big') AS big, max(CAST(CAST(bit AS INT) AS VARCHAR)) FILTER (sample='mod3') AS mod3 FROM bits GROUP BY 1")
_add("unpack_states", lambda d, _: render.unpack(d, "states", ["st"]), "states", sql="SELECT row_id, state AS st FROM states")
_add("unpack_with_coord", lambda d, s, _: render.with_coordinates(render.unpack(d, "mu", ["S1"], -1), s, 1), "mu", "sites", sql="SELECT row_id, chrom||chr(9)||(beg1-1)||chr(9)||beg1 AS coordinate, m||chr(9)||u AS \"S1\" FROM mu JOIN sites USING (row_id) WHERE sample='S1'")
_add("split_map", lambda d, _: select.split_names(select.index(d), "out_").union(select.split_names(select.index(d), named=False)), "mu", sql=", s AS (SELECT sample, row_number() OVER (ORDER BY sample) AS n FROM (SELECT DISTINCT sample FROM mu)) SELECT sample, 'out_'||sample||'.cx' AS file FROM s UNION ALL SELECT sample, 'split_'||n||'.cx' FROM s")
_add("index_append", lambda d, _: select.append_index(select.index(d), "new"), "mu", sql=", s AS (SELECT sample, row_number() OVER (ORDER BY sample)-1 AS ord FROM (SELECT DISTINCT sample FROM mu)) SELECT sample, ord FROM s UNION ALL SELECT 'new', max(ord)+1 FROM s")
_add("chrom_codes", lambda s, _: select.chrom_codes(s), "sites", sql=", c AS (SELECT chrom, CAST(row_number() OVER (ORDER BY min(row_id))-1 AS INT) AS chrom_id FROM sites GROUP BY 1) SELECT row_id, chrom_id, beg1+1 AS pos FROM sites JOIN c USING (chrom)")
_add("max_unit", lambda d, _: select.max_unit(d), "mu", sql="SELECT sample, CASE WHEN max(greatest(m,u))<15 THEN 1 WHEN max(greatest(m,u))<255 THEN 2 WHEN max(greatest(m,u))<65535 THEN 4 ELSE 8 END AS unit FROM mu GROUP BY 1")
_add("unpack_coord", lambda s, _: render.coordinate_text(s, 2).unionAll(render.coordinate_text(s, 0)), "sites", sql="SELECT row_id, chrom||'_'||beg1 AS text FROM sites UNION ALL SELECT row_id, chrom||chr(9)||(beg1-1)||chr(9)||(beg1+1) FROM sites")
_GL = "CASE WHEN b>0.67 THEN 'H' WHEN b>0.33 THEN 'M' WHEN b IS NOT NULL THEN 'L' ELSE '.' END"
_add("hprint_region", lambda d, s, _: render.region_view(d, "mu", select.region(s, "chr2"), 20), "mu", "sites", sql=", r AS (SELECT * FROM sites WHERE chrom='chr2'), z AS (SELECT min(row_id) AS f, CASE WHEN count(*)>20 THEN CAST(ceil(count(*)/20.0) AS BIGINT) ELSE 1 END AS w FROM r), g AS (SELECT sample, (row_id-f)//w AS w, avg(CAST(m AS DOUBLE)/nullif(m+u,0)) AS b FROM mu JOIN r USING (row_id) CROSS JOIN z GROUP BY 1,2) SELECT sample, string_agg(" + _GL + ", '' ORDER BY w) AS line FROM g GROUP BY 1")
_add("hprint_genome", lambda d, s, _: render.genome_view(d, "mu", s, 80), "mu", "sites", sql=", r AS (SELECT chrom, min(row_id) AS f FROM sites GROUP BY 1), z AS (SELECT greatest(1,CAST(ceil(count(*)/80.0) AS BIGINT)) AS w FROM sites), g AS (SELECT sample, chrom, (row_id-f)//w AS w, avg(CAST(m AS DOUBLE)/nullif(m+u,0)) AS b FROM mu JOIN sites USING (row_id) JOIN r USING (chrom) CROSS JOIN z GROUP BY 1,2,3) SELECT sample, chrom, string_agg(" + _GL + ", '' ORDER BY w) AS line FROM g GROUP BY 1,2")
_add("chrom_runs", lambda s, _: render.chrom_runs(s), "sites", sql="SELECT chrom, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n FROM sites GROUP BY 1")
_add("enrich_fisher", lambda b, s, _: enrich.enrich(summary.summary(b, "bits", s, "states").where("n_overlap > 0").select("query", "mask", F.col("n_univ").alias("nu"), F.col("n_mask").alias("nd"), F.col("n_query").alias("nq"), F.col("n_overlap").alias("ndq"))), "bits", "states", sql=""", c AS (SELECT q.sample AS query, k.state AS mask, count(*) AS nd, count(*) FILTER (q.bit) AS ndq FROM bits q JOIN states k USING (row_id) GROUP BY 1,2),
 t AS (SELECT query, mask, CAST(sum(nd) OVER w AS BIGINT) AS nu, nd, CAST(sum(ndq) OVER w AS BIGINT) AS nq, ndq FROM c WINDOW w AS (PARTITION BY query)),
 x AS (SELECT *, unnest(range(0, least(nd,nq)+1)) AS k FROM t WHERE ndq>0),
 p AS (SELECT query, mask, nu, nd, nq, ndq, k, CASE WHEN k>=nd+nq-nu THEN exp(lgamma(nq+1)-lgamma(k+1)-lgamma(nq-k+1)+lgamma(nu-nq+1)-lgamma(nd-k+1)-lgamma(nu-nq-nd+k+1)-lgamma(nu+1)+lgamma(nd+1)+lgamma(nu-nd+1)) ELSE 0 END AS p FROM x),
 s AS (SELECT query, mask, nu, nd, nq, ndq, least(1,sum(p) FILTER (k>=ndq)) AS g, least(1,sum(p) FILTER (k<=ndq)) AS l FROM p GROUP BY ALL)
 SELECT query, mask, nu, nd, nq, ndq, round(g,6) AS p_greater, round(l,6) AS p_less, round(least(1,2*least(g,l)),6) AS p_two_sided, round(log2(CAST(ndq*(nu-nd-nq+ndq) AS DOUBLE)/((nd-ndq)*(nq-ndq))),6) AS log2_or, round(CAST(ndq AS DOUBLE)/(nd+nq-ndq),6) AS jaccard, round(CAST(ndq AS DOUBLE)/least(nd,nq),6) AS overlap, round((log2(nd)+log2(nq)-2*log2(nu))/(log2(ndq)-log2(nu))-1,6) AS npmi, round(2.0*ndq/(nd+nq),6) AS dice FROM s""")
_add("popcount", lambda b, _: b.groupBy("sample").agg(F.count_if("bit").alias("n_on"), F.count("*").alias("n_rows")), "bits", sql="SELECT sample, count(*) FILTER (bit) AS n_on, count(*) AS n_rows FROM bits GROUP BY 1")
_add("dsample_mu", lambda d, _: sampling.dsample(d, "mu", 100).groupBy("sample").agg(F.count_if(F.expr("m + u > 0")).alias("n"), F.count("*").alias("n_rows")), "mu", sql="SELECT sample, least(100, count(*) FILTER (m+u>0)) AS n, count(*) AS n_rows FROM mu GROUP BY 1")
_add("dsample_su", lambda d, _: sampling.dsample(d, "su", 50, repeats=2).groupBy("sample").agg(F.count_if("in_uni").alias("n")), "su", sql="SELECT sample||'-'||r AS sample, least(50, count(*) FILTER (in_uni)) AS n FROM su CROSS JOIN (SELECT unnest([0,1]) AS r) GROUP BY 1")
_add("dsample_binary", lambda d, _: sampling.dsample(d, "mu", 100, to_binary=True), "mu")
_add(
    "dsample_binary_counts",
    lambda d, _: sampling.dsample(d, "mu", 100, to_binary=True).groupBy("sample").agg(F.count_if(F.expr("m + u > 0")).alias("n"), F.count_if(F.expr("m + u = 1")).alias("n_single"), F.count("*").alias("n_rows")),
    "mu",
    sql="SELECT sample, least(100, count(*) FILTER (m+u>0)) AS n, CASE WHEN count(*) FILTER (m+u>0) > 100 THEN 100 ELSE count(*) FILTER (m+u=1) END AS n_single, count(*) AS n_rows FROM mu GROUP BY 1",
)
_add("perturb_su_all", lambda d, _: sampling.perturb(d, "su", 1.0), "su", sql="SELECT sample, row_id, CASE WHEN in_uni THEN NOT in_set ELSE in_set END AS in_set, in_uni FROM su")
_add("perturb_bits", lambda b, _: sampling.perturb(b, "bits", 1.0), "bits", sql="SELECT sample, row_id, NOT bit AS bit FROM bits")
_add("perturb_su", lambda d, _: sampling.perturb(d, "su", 0.05), "su")

# options, descriptions and texts ---------------------------------------------------------------------------------------
_INDEX = "i AS (SELECT sample, row_number() OVER (ORDER BY sample)-1 AS ord FROM (SELECT DISTINCT sample FROM mu))"
_add(
    "info_full",
    lambda d, s, _: select.describe(d, "mu", select.index(d), "a.cx").union(select.describe(s, "states", file="b.cx")),
    "mu",
    "states",
    sql=""", k AS (SELECT state, min(row_id) AS f FROM states GROUP BY 1),
 w AS (SELECT *, 'N='||count(*) OVER ()||'|' AS head, coalesce(sum(length(state)+1) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)-1,0) AS before FROM k),
 t AS (SELECT head||string_agg(state, ',' ORDER BY f) FILTER (length(head)+before<=25)||CASE WHEN count(*) FILTER (length(head)+before<=25)<count(*) THEN ',...' ELSE '' END AS keys FROM w GROUP BY head)
 SELECT 'a.cx' AS file, sample, (SELECT CAST(count(DISTINCT sample) AS VARCHAR) FROM mu) AS n_col, count(*) AS n_rows, '3' AS format, CASE WHEN max(greatest(m,u))<15 THEN 1 WHEN max(greatest(m,u))<255 THEN 2 WHEN max(greatest(m,u))<65535 THEN 4 ELSE 8 END AS unit_bytes, 'NA' AS keys FROM mu GROUP BY sample
 UNION ALL SELECT 'b.cx', '1', 'NA', (SELECT count(*) FROM states), '2', 0, keys FROM t""",
)
_add("rowsub_precedence", lambda d, b, _: select.choose_rows(d, indices=[4, 2], by=_by(b), beg0=7).unionAll(select.choose_rows(d, by=_by(b), beg0=7)), "mu", "bits", sql=", o AS (SELECT row_id, row_number() OVER (ORDER BY row_id)-1 AS n FROM bits WHERE sample='mod3' AND bit) SELECT sample, CASE row_id WHEN 3 THEN CAST(0 AS BIGINT) ELSE 1 END AS row_id, m, u FROM mu WHERE row_id IN (1,3) UNION ALL SELECT sample, n, m, u FROM mu JOIN o USING (row_id)")
_add("rowsub_with_coord", lambda d, s, _: select.choose_rows(d, s, beg0=10, end1=60, coordinates=True), "mu", "sites", sql="SELECT sample, row_id-10 AS row_id, m, u, chrom, beg1 FROM mu JOIN sites USING (row_id) WHERE row_id BETWEEN 10 AND 59")
_add("rowsub_sites", lambda s, _: select.choose_rows(s, block=1, size=64), "sites", sql="SELECT row_id-64 AS row_id, chrom, beg1 FROM sites WHERE row_id BETWEEN 64 AND 127")
_add("summary_named", lambda d, _: summary.with_files(summary.summary(summary.renamed(d, select.index(d), [f"n{i}" for i in range(9)]), "mu"), "q.cx").select("q_file", "query", "m_file", "n_univ", "n_query"), "mu", sql=f", {_INDEX} SELECT 'q.cx' AS q_file, 'n'||ord AS query, 'NA' AS m_file, count(*) AS n_univ, count(*) FILTER (m+u>0) AS n_query FROM mu JOIN i USING (sample) GROUP BY ord")
_add("hprint_sites_su", lambda d, s, _: render.site_view(d, "su", select.region(s, "chr2")), "su", "sites", sql="SELECT sample, CAST(0 AS BIGINT) AS block, string_agg(CASE WHEN NOT in_uni THEN '.' WHEN in_set THEN '\u2588' ELSE '\u2591' END, '' ORDER BY row_id) AS line FROM su JOIN sites USING (row_id) WHERE chrom='chr2' GROUP BY 1")
_add("hprint_sites_deciles", lambda d, s, _: render.site_view(d, "betas", select.region(s, "chr1"), deciles=True), "beta_track", "sites", sql="SELECT sample, CAST(0 AS BIGINT) AS block, string_agg(coalesce(CAST(CAST(least(9,floor(beta*10)) AS INT) AS VARCHAR),'.'), '' ORDER BY row_id) AS line FROM beta_track JOIN sites USING (row_id) WHERE chrom='chr1' GROUP BY 1")
_add("hprint_dump", lambda d, _: render.dump(d), "su", sql="SELECT sample, row_id//1048576 AS block, string_agg(CASE WHEN NOT in_uni THEN '2' WHEN in_set THEN '1' ELSE '0' END, '' ORDER BY row_id) AS line FROM su GROUP BY 1,2")
_add("unpack_tail", lambda d, _: render.unpack_chosen(d, "mu", select.index(d), tail=2, n=-1), "mu", sql="SELECT row_id, max(m||chr(9)||u) FILTER (sample='S6') AS \"S6\", max(m||chr(9)||u) FILTER (sample='S7') AS \"S7\" FROM mu GROUP BY 1")
_add("enrich_tables", lambda d, _: enrich.tables(d.select(F.concat_ws("\t", F.lit(1000), F.col("row_id") + 1, "m", "u", "sample").alias("value"))), "mu", sql="SELECT CAST(1000 AS BIGINT) AS nu, row_id+1 AS nd, m AS nq, u AS ndq, sample AS rest FROM mu")
#: What text each kind of track is read from, in Spark and as its SQL's columns.
_LINES = {
    "bits": ("bits", "CAST(CAST(bit AS INT) AS STRING)", "sample, row_id, bit"),
    "chars": ("bits", "CAST(CAST(bit AS INT) AS STRING)", "sample, row_id, CAST(CAST(bit AS INT) AS VARCHAR) AS ch"),
    "states": ("states", "state", "sample, row_id, state"),
    "mu": ("mu", "concat_ws('\t', m, u)", "sample, row_id, m, u"),
    "betas": ("beta_track", "coalesce(CAST(beta AS STRING), 'NA')", "sample, row_id, round(beta,6) AS beta"),
    "ternary": ("su", "CASE WHEN in_uni THEN CAST(CAST(in_set AS INT) AS STRING) ELSE '2' END", "sample, row_id, CASE WHEN in_uni THEN in_set END AS bit"),
    "su": ("su", "concat_ws('\t', CAST(in_set AS INT), CAST(in_uni AS INT))", "sample, row_id, in_set, in_uni"),
    "sites": ("sites", "concat_ws('\t', chrom, beg1 - 1, beg1 + 1)", "row_id, chrom, beg1"),
}
for _kind, (_view, _line, _columns) in _LINES.items():
    _ids = ["row_id"] if _kind == "sites" else ["sample", "row_id"]
    _add(f"text_{_kind}", lambda d, _, k=_kind, x=_line, ids=_ids: d.select(*ids, F.expr(x).alias("value")).select(*ids, *(c.alias(n) for n, c in text.columns(k).items())), _view, sql=f"SELECT {_columns} FROM {_view}")
