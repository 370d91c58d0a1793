"""Summaries of query tracks, alone or against masks: one grouped aggregate over a positional join.

Kinds: bits(bit), states(state), mu(m, u), betas(beta), su(in_set, in_uni), su2bit (su as four codes), sites(chrom, beg1).
Every kernel reduces to three flags a row - in the universe, in the query, in the mask - and keys of states or codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.scalars import beta, code2, log2_odds
from sitegrid.operators.blocks import runs
from sitegrid.operators.select import same_axis

COLUMNS = ("query", "mask", "n_univ", "n_query", "n_mask", "n_overlap", "log2_odds_ratio", "beta", "depth")
_T, _N = F.lit, F.col


def _query(df: DataFrame, kind: str) -> DataFrame:
    on, value, depth, uni, key = F.lit(True), F.lit(None).cast("double"), F.lit(0).cast("bigint"), F.lit(True), F.lit(None).cast("string")
    if kind == "bits":
        on = _N("bit")
    elif kind == "mu":
        on, value, depth = (_N("m") + _N("u")) > 0, beta(_N("m"), _N("u")), _N("m") + _N("u")
    elif kind == "betas":
        on, value = _N("beta").isNotNull(), _N("beta")
    elif kind == "su":
        on, uni, depth = _N("in_set") & _N("in_uni"), _N("in_uni"), _N("in_uni").cast("bigint")
    elif kind == "su2bit":
        key = code2(_N("in_set"), _N("in_uni")).cast("string")
    elif kind == "states":
        key = _N("state")
    else:
        raise ValueError(f"no such query: {kind}")
    return df.select(_N("sample").alias("qs"), "row_id", on.alias("q"), value.alias("v"), depth.alias("d"), uni.alias("qu"), key.alias("qk"))


def _mask(df: DataFrame, kind: str) -> DataFrame:
    on, uni, key = F.lit(True), F.lit(True), F.lit(None).cast("string")
    if kind == "bits":
        on = _N("bit")
    elif kind == "su":
        on, uni = _N("in_set") & _N("in_uni"), _N("in_uni")
    elif kind == "states":
        key = _N("state")
    else:
        raise ValueError(f"a mask can't be of kind {kind}")
    return df.select(_N("sample").alias("ms"), "row_id", on.alias("m"), uni.alias("mu"), key.alias("mk"))


def _finish(df: DataFrame, masked: bool) -> DataFrame:
    depth = F.when(_N("sum_depth") > 0, _N("sum_depth") / F.when(_N("n_mask") > 0, _N("n_mask")).otherwise(_N("n_univ")))
    odds = log2_odds(_N("n_univ"), _N("n_query"), _N("n_mask"), _N("n_overlap")) if masked else F.lit(None).cast("double")
    return df.select("query", "mask", *(_N(c).cast("bigint").alias(c) for c in COLUMNS[2:6]), odds.alias("log2_odds_ratio"), _N("beta").cast("double").alias("beta"), depth.cast("double").alias("depth"))


def _ratio(a: str, b: str):
    return _N(a) / F.when(_N(b) != 0, _N(b))


def summary_sites(sites: DataFrame) -> DataFrame:
    """Rows of each run of a chromosome name; a chromosome that reappears makes a row again."""
    s = runs(sites.select("row_id", "chrom"), "chrom")
    g = s.groupBy("chrom", "run").agg(F.count("*").alias("n_query"))
    g = g.withColumn("n_univ", F.sum("n_query").over(Window.partitionBy()))
    return _finish(g.select(_N("chrom").alias("query"), F.lit("global").alias("mask"), "n_univ", "n_query", F.lit(0).alias("n_mask"), F.lit(0).alias("n_overlap"), F.lit(None).cast("double").alias("beta"), F.lit(0).alias("sum_depth")), False)


def summary(query: DataFrame, q_kind: str, mask: DataFrame | None = None, m_kind: str | None = None, pseudo_count: int = 1, tag_keys: bool = False, strict: bool = False) -> DataFrame:
    """One row for each query and mask, and for each of their keys; see COLUMNS.

    strict: unequal numbers of rows are an error. pseudo_count is added to overlaps of states with states. tag_keys prefixes keys with their track's name always.
    Masks of the same axis are joined by row; the mask's side is broadcast by Spark only if its size allows.
    """
    if q_kind == "sites":
        if mask is not None:
            raise ValueError("coordinates can't be masked")
        return summary_sites(query)
    q, keyed = _query(query, q_kind), q_kind in ("states", "su2bit")
    if mask is None:
        rows = q.withColumn("ms", F.lit("global")).withColumn("m", F.lit(True)).withColumn("mu", F.lit(True)).withColumn("mk", F.lit(None).cast("string"))
    else:
        if strict:
            same_axis(query, mask)
        rows = q.join(_mask(mask, m_kind), "row_id")
    univ = _N("qu") & (_N("mu") if q_kind in ("bits", "su") and m_kind == "su" else F.lit(True))
    g = rows.withColumn("w", univ).groupBy("qs", "ms", "qk", "mk").agg(
        F.count("*").alias("n"), F.count_if("w").alias("univ"), F.count_if(_N("w") & _N("q")).alias("nq"), F.count_if(_N("w") & _N("m")).alias("nm"), F.count_if(_N("w") & _N("q") & _N("m")).alias("no"),
        F.sum(F.when(_N("w") & _N("q") & _N("m"), _N("v"))).alias("sv"), F.sum(F.when(_N("w") & _N("m"), _N("d"))).alias("sd"),
    )
    both = Window.partitionBy("qs", "ms")
    if not keyed:
        g = g.withColumn("n_univ", F.sum("univ").over(both)).withColumn("n_query", F.sum("nq").over(both))
        n_mask = F.lit(0) if mask is None and q_kind in ("mu", "betas") else _N("nm")
        g = g.withColumn("n_mask", n_mask).withColumn("n_overlap", _N("no"))
        b = {"bits": F.lit(0.0), "su": _ratio("n_query", "n_univ") if mask is None else _ratio("n_overlap", "n_mask")}.get(q_kind, _ratio("sv", "n_overlap"))
        g = g.withColumn("beta", b).withColumn("sum_depth", _N("sd") if q_kind == "mu" or q_kind == "su" and mask is None else F.lit(0))
        name = F.when(_N("mk").isNull(), _N("ms")).otherwise(F.concat_ws("-", "ms", "mk") if tag_keys else _N("mk"))
        return _finish(g.withColumn("query", _N("qs")).withColumn("mask", name), mask is not None)
    # all combinations of keys; keys are categories, a bounded list for each track
    q_keys = g.select("qs", "ms", "qk").distinct() if q_kind == "states" else g.select("qs", "ms").distinct().withColumn("qk", F.explode(F.array(*(F.lit(str(c)) for c in range(4)))))
    full = q_keys.join(g.select("qs", "ms", "mk").distinct(), ["qs", "ms"]) if m_kind == "states" else q_keys.withColumn("mk", F.lit(None).cast("string"))
    h = full.alias("f").join(g.alias("g"), (_N("f.qs") == _N("g.qs")) & (_N("f.ms") == _N("g.ms")) & (_N("f.qk") == _N("g.qk")) & _N("f.mk").eqNullSafe(_N("g.mk")), "left").select("f.*", *(F.coalesce(_N(f"g.{c}"), F.lit(0)).alias(c) for c in ("n", "nm")))
    h = h.withColumn("n_univ", F.sum("n").over(both)).withColumn("n_query", F.sum("n").over(Window.partitionBy("qs", "ms", "qk")))
    in_key = F.sum("nm").over(Window.partitionBy("qs", "ms", "mk"))
    if mask is None:
        h = h.withColumn("n_mask", _N("n_univ") if q_kind == "su2bit" else F.lit(0)).withColumn("n_overlap", _N("n_query") if q_kind == "su2bit" else F.lit(0))
    else:
        h = h.withColumn("n_mask", in_key).withColumn("n_overlap", _N("nm") + (pseudo_count if q_kind == m_kind == "states" else 0))
    b = F.lit(1.0) if mask is None and q_kind == "su2bit" else _ratio("n_overlap", "n_mask") if q_kind == "su2bit" and m_kind == "states" else F.lit(0.0)
    if q_kind == "su2bit":
        q_name = F.concat_ws("|", "qs", "qk")
    else:
        q_name = F.concat_ws("-", "qs", "qk") if tag_keys or m_kind in ("bits", "su") else _N("qk")
    m_name = F.when(_N("mk").isNotNull(), F.concat_ws("-", "ms", "mk") if tag_keys else _N("mk")).otherwise(F.concat(_N("ms"), F.lit("|1")) if q_kind == "su2bit" and mask is not None else _N("ms"))
    return _finish(h.withColumn("query", q_name).withColumn("mask", m_name).withColumn("beta", b).withColumn("sum_depth", F.lit(0)), mask is not None)


def renamed(tracks: DataFrame, samples: DataFrame, names: list[str]) -> DataFrame:
    """Tracks called names, in the order of samples(sample, ord), for a summary; fewer names than samples are an error."""
    n = samples.count()
    if n > len(names):
        raise ValueError(f"{len(names)} names for {n} tracks")
    new = tracks.sparkSession.createDataFrame(list(enumerate(names)), "ord bigint, new_name string")
    return tracks.join(samples.join(new, "ord").select("sample", "new_name"), "sample").withColumn("sample", F.col("new_name")).drop("new_name")


def with_files(result: DataFrame, q_file: str, m_file: str = "NA") -> DataFrame:
    """A summary with the files of its query and mask in front."""
    return result.select(F.lit(q_file).alias("q_file"), *result.columns[:1], F.lit(m_file).alias("m_file"), *result.columns[1:])
