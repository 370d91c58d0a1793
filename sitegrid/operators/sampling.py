"""Down-sampling and noise. Random numbers are hashes of seed, sample, repeat and row, so no partitioning changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.functions.scalars import beta


def uniform(seed: int, *of: str) -> Column:
    """In [0, 1), by the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 53)) / float(1 << 53)


def dsample(df: DataFrame, kind: str, n: int = 100, seed: int = 1, repeats: int = 1, to_binary: bool = False, prefix: str = "") -> DataFrame:
    """Exactly n eligible rows of each sample kept, the others emptied; samples with no more than n stay as they are.

    Rows are ranked by hash. The rank is found without ordering a whole sample in one task: rows fall in hash buckets
    whose counts give the bucket where the n-th row lies, and only that bucket is ordered.
    """
    if kind not in ("mu", "su"):
        raise ValueError(f"{kind} can't be down-sampled")
    eligible = F.col("m") + F.col("u") > 0 if kind == "mu" else F.col("in_uni")
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("eligible", eligible)
    name = F.when(F.lit(repeats == 1), F.col("sample")).otherwise(F.concat_ws("-", "sample", *([F.lit(prefix)] if prefix else []), "rep"))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "sample", "rep", "row_id")).withColumn("bucket", F.shiftright("h", 52))
    from pyspark.sql import Window

    counts = d.where("eligible").groupBy("sample", "rep", "bucket").agg(F.count("*").alias("c"))
    run = Window.partitionBy("sample", "rep").orderBy("bucket")
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy("sample", "rep")))
    d = d.join(counts, ["sample", "rep", "bucket"], "left")
    edge = d.where((F.col("eligible")) & (F.col("before") < n) & (F.col("before") + F.col("c") > n)).withColumn("r", F.row_number().over(Window.partitionBy("sample", "rep").orderBy("h", "row_id"))).where(F.col("before") + F.col("r") <= n).select("sample", "rep", "row_id", F.lit(True).alias("last"))
    d = d.join(edge, ["sample", "rep", "row_id"], "left")
    kept = F.col("eligible") & ((F.col("total") <= n) | (F.col("before") + F.col("c") <= n) | F.coalesce("last", F.lit(False)))
    if kind == "su":
        return d.select(name.alias("sample"), "row_id", (F.col("in_set") & kept).alias("in_set"), kept.alias("in_uni"))
    hit = uniform(seed + 1, "sample", "rep", "row_id") < beta(F.col("m"), F.col("u"))
    binary = F.lit(to_binary) & (F.col("total") > n)
    m = F.when(~kept, 0).when(binary, hit.cast("bigint")).otherwise(F.col("m"))
    u = F.when(~kept, 0).when(binary, (~hit).cast("bigint")).otherwise(F.col("u"))
    return d.select(name.alias("sample"), "row_id", m.cast("bigint").alias("m"), u.cast("bigint").alias("u"))


def perturb(df: DataFrame, kind: str, p: float = 0.05, seed: int = 1) -> DataFrame:
    """Bits flipped with probability p; of sets, only rows in the universe."""
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")
    flip = uniform(seed, "sample", "row_id") < p
    if kind == "bits":
        return df.select("sample", "row_id", (F.col("bit") != flip).alias("bit"))
    if kind == "su":
        return df.select("sample", "row_id", (F.col("in_set") != (flip & F.col("in_uni"))).alias("in_set"), "in_uni")
    raise ValueError(f"{kind} can't be perturbed")
