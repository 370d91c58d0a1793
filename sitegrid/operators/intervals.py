"""Sites against intervals. Both sides are cut in bins, so the range condition is checked within an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions to a bin.
BIN = 1 << 17


def _overlaps(sites: DataFrame, intervals: DataFrame, bins: int) -> DataFrame:
    """Pairs of a site, which spans [beg1 - 1, beg1 + 1), and an interval [beg0, end0); each pair once."""
    s = sites.withColumn("bin", F.explode(F.sequence(F.floor((F.col("beg1") - 1) / bins), F.floor(F.col("beg1") / bins))))
    i = intervals.where("end0 > beg0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("beg0") / bins), F.floor((F.col("end0") - 1) / bins))))
    both = s.join(i, ["chrom", "bin"]).where((F.col("beg1") - 1 < F.col("end0")) & (F.col("beg1") + 1 > F.col("beg0")))
    return both.where(F.col("bin") == F.floor(F.greatest(F.col("beg1") - 1, F.col("beg0")) / bins))


def count_overlaps(sites: DataFrame, intervals: DataFrame, bins: int = BIN) -> DataFrame:
    """(row_id, n): how many intervals overlap each site."""
    n = _overlaps(sites, intervals, bins).groupBy("row_id").agg(F.count("*").alias("n"))
    return sites.select("row_id").join(n, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))


def label(sites: DataFrame, intervals: DataFrame, bins: int = BIN) -> DataFrame:
    """(row_id, state): the name of the first overlapping interval by begin, end and name; '.' without any."""
    first = _overlaps(sites, intervals, bins).groupBy("row_id").agg(F.min_by("name", F.struct("beg0", "end0", "name")).alias("state"))
    return sites.select("row_id").join(first, "row_id", "left").select("row_id", F.coalesce("state", F.lit(".")).alias("state"))


def align(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts called at coordinates (chrom, beg1, m, u), on the axis of sites; 0 0 where nothing is called."""
    return sites.join(calls, ["chrom", "beg1"], "left").select("row_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("m", "u")))


def windows(sites: DataFrame, width: int = 100_000) -> DataFrame:
    """(row_id, state): the window of each site as chrom:begin-end, 0-based."""
    w = F.floor((F.col("beg1") - 1) / width) * width
    return sites.select("row_id", F.concat(F.col("chrom"), F.lit(":"), w, F.lit("-"), w + width).alias("state"))
