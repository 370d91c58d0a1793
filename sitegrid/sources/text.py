"""Text tracks, one line a row, in typed columns; and tracks written by sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """Lines of one text with their 0-based number: partition sizes first, then an offset to each partition's own count."""
    d = df.select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"))
    sizes = d.groupBy("part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    start = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return d.join(F.broadcast(start), "part").select("value", (F.col("mid") - F.shiftleft(F.col("part").cast("bigint"), 33) + F.col("start")).alias("row_id"))


def columns(kind: str) -> dict[str, Column]:
    """The typed columns of a line `value`."""
    v = F.col("value")
    f = F.split(v, "\t", -1)
    number = lambda i: F.when(F.try_element_at(f, F.lit(i)).rlike("^[0-9]+$"), F.try_element_at(f, F.lit(i)).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no count in: "), v)).cast("bigint"))
    if kind == "bits":
        return {"bit": F.substring(v, 1, 1) != "0"}
    if kind == "chars":
        return {"ch": F.substring(v, 1, 1)}
    if kind == "states":
        return {"state": F.coalesce(F.nullif(v, F.lit("")), F.lit("NA"))}
    if kind == "mu":
        return {"m": number(1), "u": number(2)}
    if kind == "betas":
        b = F.when(v.rlike(r"^-?[0-9]*\.?[0-9]*([eE][-+]?[0-9]+)?$"), F.coalesce(F.expr("try_cast(value as float)"), F.when(v == "", F.lit(0.0)))).cast("double")
        return {"beta": F.when(b >= 0, b)}
    if kind == "ternary":
        return {"bit": F.when(v.startswith("0"), False).when(v.startswith("1"), True)}
    if kind == "su":
        return {"in_set": f[0] == "1", "in_uni": F.coalesce(F.expr(r"try_cast(regexp_extract(split(value, '\t', -1)[1], '^\\s*([-+]?[0-9]+)', 1) as bigint)"), F.lit(0)) != 0}
    if kind == "sites":
        return {"chrom": f[0], "beg1": f[1].cast("bigint") + 1}
    raise ValueError(f"no such kind: {kind}")


def read(spark: SparkSession, path: str, kind: str, sample: str | None = None) -> DataFrame:
    """A text file, plain or gzipped, as a track."""
    d = numbered(spark.read.text(path))
    return d.select(*([F.lit(sample).alias("sample")] if sample is not None else []), "row_id", *(c.alias(n) for n, c in columns(kind).items()))


def line_blocks(lines: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Numbered lines (value, row_id) with the block that each falls in."""
    return lines.withColumn("block", F.floor(F.col("row_id") / size))


def write(df: DataFrame, path: str) -> None:
    """Tracks as Parquet by sample, so that a reader of some samples opens only theirs."""
    df.write.partitionBy("sample").parquet(path)
