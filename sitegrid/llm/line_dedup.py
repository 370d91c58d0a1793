"""Cross-site boilerplate lines, found by how many distinct sites carry a line. DataFrame functions only.

One HyperLogLog sketch of sites per line hash is merged by aggregation, so a line on any number of rows is combined
before the shuffle. Sketches decide the clear cases; lines whose estimate lies near the threshold get an exact distinct
count, from distinct (line, site) rows that only these lines make. A line on enough sites is boilerplate and goes from
every document that has lines of its own besides.

Texts are cut where they are read. Up to ``in_place`` boilerplate lines are looked up in a hash set that is part of the
expression. Beyond that, a Bloom filter of bounded size passes all texts that can't hold such a line, and only the others
are shuffled, to meet the lines that they do hold; either way decides exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import Tables, bloom, materialize

#: What is trimmed from a line before it is compared.
EDGES = " \t\r"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trim(line))


def _cut(docs: DataFrame, keep: tuple[str, ...], common: Callable[[Column], Column] | None) -> DataFrame:
    """docs(id, text, rest) without the lines whose hash is common, where other lines remain."""
    lines = F.split("text", "\n", -1)
    own = F.filter(lines, lambda x: (_trim(x) == "") | ~common(_hash(x))) if common else lines
    parts = docs.withColumn("lines", lines).withColumn("own", own)
    gone = F.size("lines") - F.size("own")
    cut = F.coalesce((gone > 0) & F.exists("own", lambda x: _trim(x) != ""), F.lit(False)) if common else F.lit(False)
    return parts.select(
        "id",
        F.when(cut, F.array_join("own", "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(cut, gone).otherwise(0).cast("long").alias("n_removed"),
        *(F.col("rest").getField(c).alias(c) for c in keep),
    )


def boilerplate(docs: DataFrame, min_sites: int, lg_k: int, margin: float) -> DataFrame:
    """docs(text, site) -> (h): hashes of the lines on enough sites. Written; one row a line."""
    line = docs.select("site", F.explode(F.split("text", "\n", -1)).alias("line")).where(_trim(F.col("line")) != "").select("site", _hash(F.col("line")).alias("h"))
    sites = docs.agg(F.count_distinct("site")).first()[0]
    least = max(3, min(min_sites, -(-sites // 2)))
    with Tables(docs.sparkSession) as written:
        sketches = line.groupBy("h").agg(F.count("site").alias("n"), F.hll_sketch_agg("site", lg_k).alias("sites")).where(F.col("n") >= least)
        spread = written(sketches.select("h", F.hll_sketch_estimate("sites").alias("about")).where(F.col("about") >= least * (1 - margin)), "spread")
        near = spread.where(F.col("about") <= least * (1 + margin)).select("h")
        exact = line.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("site").alias("sites")).where(F.col("sites") >= least).select("h")
        return materialize(spread.where(F.col("about") > least * (1 + margin)).select("h").union(exact), "common")


def line_dedup(docs: DataFrame, min_sites: int = 12, lg_k: int = 12, margin: float = 0.2, in_place: int = 10_000, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, text, n_lines, n_removed: long): texts without their cross-site boilerplate lines.

    A line is what newlines separate, compared without blanks at its ends; blank lines are kept. A line is boilerplate
    if at least min_sites distinct non-null sites carry it; where there are few sites, half of them are enough, but never
    less than 3. Boilerplate goes from every document with other lines; a document of nothing else is a copy and is left
    whole for near-duplicate removal. Null texts stay null with 0 lines; lines of null sites count for no site but are
    removed like others. Lines are told apart by 64-bit hashes. Every row is treated by its own text, repeated rows and
    rows without an id too. Of the other columns, those named in keep are kept. An empty table gives an empty one. margin:
    relative distance from the threshold within which sites are counted exactly; it is several times the sketch's error of
    about 1.04 / sqrt(2 ** lg_k). in_place: boilerplate lines, at most, that are looked up without any shuffle of texts.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"), F.struct(F.lit(0), *keep).alias("rest"))
    common = boilerplate(d.select("text", "site"), min_sites, lg_k, margin)
    d = d.drop("site")
    n = common.count()
    if n <= in_place:
        some = [r.h for r in common.collect()]
        out = _cut(d, keep, (lambda h: h.isin(some)) if some else None)
    else:
        bits, test = bloom(common, n)
        may = lambda h: test(F.col("bits"), h)
        d = d.withColumn("bits", bits).withColumn("hit", F.coalesce(F.exists(F.split("text", "\n", -1), lambda x: (_trim(x) != "") & may(_hash(x))), F.lit(False)))
        hit = d.where("hit").withColumn("key", F.md5("text"))
        line = hit.select("key", "bits", F.explode(F.split("text", "\n", -1)).alias("line")).select("key", "bits", _hash(F.col("line")).alias("h"))
        held = materialize(line.where(may(F.col("h"))).select("key", "h").join(common, "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("held")), "held")
        both = hit.join(held, "key", "left").withColumn("held", F.coalesce("held", F.array().cast("array<long>")))
        out = _cut(both, keep, lambda h: F.array_contains("held", h)).unionByName(_cut(d.where("not hit"), keep, None))
    return out.withColumnRenamed("id", id_col)


SQL = """
WITH line AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents),
common AS (SELECT line FROM line WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= (SELECT greatest(3, least(12, ceil(count(DISTINCT source) / 2))) FROM documents)),
lost AS (SELECT doc_id, list(DISTINCT line) AS common FROM line WHERE line IN (SELECT line FROM common) GROUP BY doc_id),
parts AS (SELECT d.doc_id, text, string_split(text, chr(10)) AS lines, coalesce(common, []) AS common FROM documents d LEFT JOIN lost USING (doc_id)),
kept AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(common, trim(x, ' ' || chr(9) || chr(13)))) AS own FROM parts),
cut AS (SELECT *, len(own) < len(lines) AND len(list_filter(own, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0 AS cut FROM kept)
SELECT doc_id, CASE WHEN cut THEN array_to_string(own, chr(10)) ELSE text END AS text,
 CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines, CAST(CASE WHEN cut THEN len(lines) - len(own) ELSE 0 END AS BIGINT) AS n_removed
FROM cut
"""
