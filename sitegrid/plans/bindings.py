"""Tracks over the driver's star-schema tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "sites": "SELECT p_partkey AS row_id, 'chr'||CAST(CAST(floor(p_partkey/64) AS INT)+1 AS STRING) AS chrom, CAST(1+(p_partkey%64)*5000+p_size*10 AS BIGINT) AS beg1 FROM part",
    "mu": "SELECT x.sample, p.p_partkey AS row_id, COALESCE(c.m,0) AS m, COALESCE(c.u,0) AS u FROM part p CROSS JOIN (SELECT DISTINCT l_linenumber AS ln, 'S'||CAST(l_linenumber AS STRING) AS sample FROM lineitem) x LEFT JOIN (SELECT l_linenumber AS ln, l_partkey, CAST(SUM(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS m, CAST(SUM(CASE WHEN l_linestatus<>'F' THEN 1 ELSE 0 END) AS BIGINT) AS u FROM lineitem GROUP BY 1,2) c ON c.ln=x.ln AND c.l_partkey=p.p_partkey",
    "states": "SELECT 'st' AS sample, p_partkey AS row_id, p_type AS state FROM part",
    "brands": "SELECT 'brand' AS sample, p_partkey AS row_id, p_brand AS state FROM part",
    "bits": "SELECT 'big' AS sample, p_partkey AS row_id, p_size>25 AS bit FROM part UNION ALL SELECT 'mod3', p_partkey, p_size%3=0 FROM part",
    "betas": "SELECT 'S'||CAST(l_linenumber AS STRING) AS sample, l_partkey AS row_id, AVG(l_discount)*10 AS beta FROM lineitem GROUP BY 1,2",
    "su": "SELECT sample, row_id, (m+u)>=3 AS in_uni, CASE WHEN (m+u)>=3 THEN m>=u ELSE m>u END AS in_set FROM mu",
    "intervals": "SELECT 'chr'||CAST(s_suppkey%4+1 AS STRING) AS chrom, (s_suppkey*7919)%300000 AS beg0, (s_suppkey*7919)%300000+20000 AS end0, s_name AS name FROM supplier",
}
#: Dense betas: every part in every sample, NULL where it has none; stored as 32-bit floats.
VIEWS["beta_track"] = "SELECT x.sample, p.p_partkey AS row_id, CAST(CAST(b.beta AS FLOAT) AS DOUBLE) AS beta FROM part p CROSS JOIN (SELECT DISTINCT sample FROM betas) x LEFT JOIN betas b ON b.sample=x.sample AND b.row_id=p.p_partkey"
NEEDS = {"su": ("mu",), "beta_track": ("betas",)}


def with_views(*names: str) -> str:
    """A WITH clause, without its keyword, that defines the views for DuckDB."""
    every: list[str] = []
    for n in names:
        every += [x for x in (*NEEDS.get(n, ()), n) if x not in every]
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in every)


def track(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the columns that it names are read."""
    sql, tables = VIEWS[name], {}
    for t in ("part", "lineitem", "supplier"):
        if f" {t}" in sql:
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for n in NEEDS.get(name, ()):
        tables[n] = track(spark, sf_dir, n)
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t} ", "JOIN {" + t + "} ")
    return spark.sql(sql, **tables)
