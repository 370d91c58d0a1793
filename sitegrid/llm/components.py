"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import Tables, materialize


def _large_star(links: DataFrame, written: Tables) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, written: Tables) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    to = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> (id, component): for every id in a link, the smallest id that links reach.

    Alternating large-star and small-star contraction: each round points every node at a smaller neighbour, so the
    number of rounds grows with the logarithm of the longest path. Minima are aggregated before the shuffle and joined
    back from written tables, so a hub with any number of links is split like any skewed join. Nulls and self-links
    are ignored; an empty table gives an empty one.
    """
    with Tables(links.sparkSession) as written:
        now = written(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links")
        mark = None
        for _ in range(64):
            seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
            if mark == seen or seen[0] == 0:
                break
            mark = seen
            large = written(_large_star(now, written).where("a <> b").distinct(), "large")
            now = written(_small_star(large, written).where("a <> b").distinct(), "small")
        roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
        return materialize(now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), "components")
