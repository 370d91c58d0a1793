"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Sizes are words. Each source gets a target; a target is whole epochs of its source and a remainder, which blocks of
equal size fill. The blocks of all sources are apportioned together by highest quotients: the seat that a source's
k-th block takes has the quotient remainder / (2 k + 1). The same rule divides a source's blocks among its shards, hash
groups of a bounded number of words, so that quotas add up to the source's blocks and no order over a whole source's
documents is ever needed. In a shard, documents stand in a seeded order and are cut in blocks; the shard's quota takes its
first blocks.

Of S parties that share a house of H seats, one with a share of x seats gets between x (1 - S / 2H) and x (1 + S / 2H),
rounded: only the seats between are ranked, 4 S at most in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources(source, source_size) with weight and target: shares of the total by weight, none above most x its size.

    One row per source, ordered in one task; the number of rows read there is the number of sources, not of documents.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    r = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights)) + 1)).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("open", F.sum("weight").over(r.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # in order of cap / weight, the level rises as long as it reaches the next source's ratio, and falls after that
    s = s.withColumn("free", F.max("level").over(Window.partitionBy()))
    return s.select("source", "source_size", "weight", F.when(F.col("ratio") <= F.col("free"), F.col("cap").cast("double")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], name: list[str], seats: str) -> DataFrame:
    """parties(*group, *name, share double, house long) with seats: each group's house divided by highest quotients.

    share: what a party would get if seats could be split; shares of a group add up to its house, or nearly. Ties go to the
    smaller name, null last. Rows of a group that are ranked meet in one task: as many as it has parties, times 4 at most.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("spread", F.count("*").over(whole) / F.greatest(F.lit(1), 2 * F.col("house")))
    most = F.when(F.col("house") > 0, F.floor(F.col("share") * (1 + F.col("spread")) + 0.5) + 1).otherwise(0)
    p = p.withColumn("low", F.when(F.col("house") > 0, F.greatest(F.lit(0), F.floor(F.col("share") * (1 - F.col("spread")) + 0.5) - 1)).otherwise(0)).withColumn("high", F.when(F.col("share") > 0, most).otherwise(F.col("low")))
    p = p.withColumn("open", F.col("house") - F.sum("low").over(whole))
    ranked = p.withColumn("k", F.explode(F.expr("case when high > low then sequence(low, high - 1) else array(low) end"))).withColumn("quotient", F.when(F.col("k") < F.col("high"), F.col("share") / (2 * F.col("k") + 1)).otherwise(-1.0))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("quotient"), *(F.col(n).asc_nulls_last() for n in name), "k"))
    won = (F.col("place") <= F.col("open")) & (F.col("quotient") > 0)
    names = [*group, *name]
    return ranked.withColumn("place", place).groupBy(*names).agg((F.first("low") + F.sum(F.when(won, 1).otherwise(0))).cast("long").alias(seats))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 64, shard_words: int = 65_536, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole_rows: bool = False) -> DataFrame:
    """(id_col, source, size, source_size, target, taken, epochs): how many words of each document the mix takes.

    taken counts repeats: epochs whole passes over the document plus the words of it that lie in chosen blocks, so it
    never exceeds most x size. Null and empty texts have size 0 and are never taken; null is a source of its own, the
    last in order. An empty table gives an empty one. Repeated rows are taken each; rows without an id are placed by
    their texts. Other columns are ignored, or kept as a struct "row" with the given ones if whole_rows. Ties in quotients
    go to the smaller source or shard. A source's taken words differ from its target by at most a block, and by what
    shards lack that are smaller than the blocks of their quota.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    named = F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("place"), *row)
    d = materialize(d, "sizes")
    goal = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    goal = materialize(goal, "goal")
    house = F.round(F.sum("rest").over(Window.partitionBy()) / block).cast("long")
    seats = apportion(goal.select("source", (F.col("rest") / block).alias("share"), house.alias("house")), [], ["source"], "seats")
    same = lambda x, y: x["source"].eqNullSafe(y["g_source"])
    seats = seats.withColumnRenamed("source", "g_source")
    goal = materialize(goal.join(seats, same(goal, seats)).select("g_source", "source_size", "target", "epochs", "shards", "seats"), "seats")
    shard = F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("shards"))
    placed = d.join(goal, same(d, goal)).withColumn("shard", shard)
    shards = placed.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("house"), F.first("source_size").alias("of"))
    quotas = apportion(shards.select("source", "shard", (F.col("house") * (F.col("shard_size") / F.col("of"))).alias("share"), "house"), ["source"], ["shard"], "quota")
    quotas = materialize(quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "quota"), "quotas")
    in_shard = Window.partitionBy("source", "shard").orderBy("place", "id")
    placed = placed.withColumn("end", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, placed["source"].eqNullSafe(quotas["q_source"]) & (placed["shard"] == quotas["q_shard"]), "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    chosen = F.greatest(F.lit(0), F.least(F.col("end"), F.col("quota") * block) - (F.col("end") - F.col("size")))
    taken = F.col("epochs") * F.col("size") + F.least(chosen, (most - F.col("epochs")) * F.col("size"))
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("epochs").cast("long").alias("epochs"), *(["row"] if whole_rows else []))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs in the mix: a document as often as it is taken, to the nearest whole number."""
    taken = mix(docs, **how, whole_rows=True).where("taken > 0").select("row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, CAST((CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
f AS (SELECT *, max(level) OVER () AS free FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= free THEN CAST(cap AS DOUBLE) ELSE free * weight END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
h AS (SELECT *, target - epochs * source_size AS rest, greatest(1, CAST(ceil(source_size / 65536) AS BIGINT)) AS shards FROM e),
q AS (SELECT source, rest / 64 AS share, CAST(round(sum(rest) OVER () / 64) AS BIGINT) AS house, count(*) OVER () AS parties FROM h),
b AS (SELECT *, CASE WHEN house > 0 THEN greatest(0, CAST(floor(share * (1 - parties / greatest(1, 2 * house)) + 0.5) AS BIGINT) - 1) ELSE 0 END AS low, CASE WHEN house > 0 AND share > 0 THEN CAST(floor(share * (1 + parties / greatest(1, 2 * house)) + 0.5) AS BIGINT) + 1 ELSE 0 END AS high FROM q),
k AS (SELECT source, share, unnest(range(low, high)) AS k FROM b),
c AS (SELECT source, row_number() OVER (ORDER BY share / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS place FROM k),
g AS (SELECT h.*, low + (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM h.source AND c.place <= b.house - (SELECT sum(low) FROM b)) AS seats FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
p AS (SELECT d.doc_id, d.source, d.size, d.place, g.source_size, g.target, g.epochs, g.seats, CAST('0x' || substr(d.place, 1, 8) AS BIGINT) % g.shards AS shard FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
sh AS (SELECT source, shard, any_value(seats) AS house, any_value(seats) * (CAST(sum(size) AS DOUBLE) / any_value(source_size)) AS share, count(*) OVER (PARTITION BY source) AS parties FROM p WHERE size > 0 GROUP BY source, shard),
sb AS (SELECT *, CASE WHEN house > 0 THEN greatest(0, CAST(floor(share * (1 - parties / greatest(1, 2 * house)) + 0.5) AS BIGINT) - 1) ELSE 0 END AS low, CASE WHEN house > 0 AND share > 0 THEN CAST(floor(share * (1 + parties / greatest(1, 2 * house)) + 0.5) AS BIGINT) + 1 ELSE 0 END AS high FROM sh),
so AS (SELECT *, house - sum(low) OVER (PARTITION BY source) AS open FROM sb),
sk AS (SELECT source, shard, share, open, unnest(range(low, high)) AS k FROM so),
sc AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY share / (2 * k + 1) DESC, shard, k) AS place FROM sk),
sw AS (SELECT source, shard, count(*) AS won FROM sc WHERE place <= open GROUP BY source, shard),
qu AS (SELECT so.source, so.shard, low + coalesce(won, 0) AS quota FROM so LEFT JOIN sw ON so.source IS NOT DISTINCT FROM sw.source AND so.shard = sw.shard),
o AS (SELECT p.*, coalesce(quota, 0) AS quota, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM p LEFT JOIN qu ON p.source IS NOT DISTINCT FROM qu.source AND p.shard = qu.shard)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(0, least(stop, 64 * quota) - (stop - size)), (3 - epochs) * size) AS BIGINT) AS taken FROM o
"""
