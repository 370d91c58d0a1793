"""Aggregates across samples for each row, neighbours of a row, and comparisons of two samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalars import beta


def binasum(df: DataFrame, kind: str, low: float = 0.4, high: float = 0.6, min_cov: int = 1) -> DataFrame:
    """(row_id, m, u): votes of samples. Counts with a level above high vote m, below low vote u."""
    if kind == "mu":
        b, enough = beta(F.col("m"), F.col("u")), (F.col("m") + F.col("u") > 0) & (F.col("m") + F.col("u") >= min_cov)
        yes, no = enough & (b > high), enough & (b < low)
    elif kind in ("bits", "chars"):
        yes = F.col("bit") if kind == "bits" else F.col("ch") != "0"
        no = ~yes
    else:
        raise ValueError(f"binasum doesn't take {kind}")
    return df.groupBy("row_id").agg(F.count_if(yes).alias("m"), F.count_if(no).alias("u"))


def musum(mu: DataFrame) -> DataFrame:
    return mu.groupBy("row_id").agg(F.sum("m").alias("m"), F.sum("u").alias("u"))


def stat(mu: DataFrame, min_cov: int = 1) -> DataFrame:
    """(row_id, n, mean_beta, sd_beta, delta_beta, min_n) over samples with at least min_cov reads."""
    c = F.col("m") + F.col("u")
    d = mu.select("row_id", F.when((c > 0) & (c >= min_cov), beta(F.col("m"), F.col("u"))).alias("b"))
    up, down = F.when(F.col("b") > 0.5, F.col("b")), F.when(F.col("b") < 0.5, F.col("b"))
    return d.groupBy("row_id").agg(F.count("b").alias("n"), F.avg("b").alias("mean_beta"), F.stddev_pop("b").alias("sd_beta"), (F.min(up) - F.max(down)).alias("delta_beta"), F.least(F.count(up), F.count(down)).alias("min_n"))


def binstring(mu: DataFrame, samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(row_id, bits): a string of 0 and 1 in the order of samples(sample, ord); ties and missing values are 0."""
    d = mu.join(samples, "sample").select("row_id", "ord", F.when(beta(F.col("m"), F.col("u")) > threshold, "1").otherwise("0").alias("bit"))
    return d.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bit"))), lambda x: x.bit), "").alias("bits"))


def cometh(mu: DataFrame, window: int = 5, min_cov: int = 1, exclude_intermediate: bool = False) -> DataFrame:
    """(row_id, k, uu, um, mu, mm): samples by classes at a row and its k-th neighbour, for k up to window.

    A tie of m and u is methylated. Rows whose whole window lies on the axis are counted, other rows have zeros.
    Neighbours meet by an equi-join on the shifted row, so nothing is ordered.
    """
    c = F.col("m") + F.col("u")
    keep = (c > 0) & (c >= min_cov)
    if exclude_intermediate:
        keep = keep & (F.abs(beta(F.col("m"), F.col("u")) - 0.5) >= 0.2)
    d = mu.select("sample", "row_id", (F.col("m") >= F.col("u")).alias("meth"), keep.alias("ok"))
    left = d.where("ok").select("sample", "row_id", F.col("meth").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("k")).withColumn("other", F.col("row_id") + F.col("k"))
    pair = left.join(d.where("ok").select("sample", F.col("row_id").alias("other"), F.col("meth").alias("b")), ["sample", "other"])
    a, b = F.col("a"), F.col("b")
    counts = pair.groupBy("row_id", "k").agg(F.count_if(~a & ~b).alias("uu"), F.count_if(~a & b).alias("um"), F.count_if(a & ~b).alias("mu"), F.count_if(a & b).alias("mm"))
    last = mu.agg(F.max("row_id").alias("last"))
    rows = mu.select("row_id").distinct().crossJoin(F.broadcast(last)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(window))))
    full = F.col("row_id") + window <= F.col("last")
    return rows.join(counts, ["row_id", "k"], "left").select("row_id", "k", *(F.when(full, F.coalesce(x, F.lit(0))).otherwise(0).cast("bigint").alias(x) for x in ("uu", "um", "mu", "mm")))


def pairwise(mu: DataFrame, first: str, second: str, direction: int = 1, delta: float = -1.0, min_cov: int = 1) -> DataFrame:
    """(row_id, in_set, in_uni): rows where two samples differ. direction 1: first above, 2: second above, 3: either."""
    if direction not in (1, 2, 3):
        raise ValueError("direction is 1, 2 or 3")
    side = lambda s, n: mu.where(F.col("sample") == s).select("row_id", beta(F.col("m"), F.col("u")).alias(f"b{n}"), (F.col("m") + F.col("u")).alias(f"c{n}"))
    d = side(first, 1).join(side(second, 2), "row_id")
    uni = (F.col("c1") >= max(1, min_cov)) & (F.col("c2") >= max(1, min_cov))
    gap = F.col("b1") - F.col("b2")
    hit = {1: (gap > 0) & (gap > delta), 2: (gap < 0) & (-gap > delta), 3: (gap != 0) if delta <= 0 else F.abs(gap) > delta}[direction]
    return d.select("row_id", F.coalesce(uni & hit, F.lit(False)).alias("in_set"), uni.alias("in_uni"))
