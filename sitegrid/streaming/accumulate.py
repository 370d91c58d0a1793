"""An extension: sums over samples that arrive as a stream of rows (sample, row_id, m, u)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Counts in Parquet files that are added to a folder."""
    return spark.readStream.schema("sample string, row_id bigint, m bigint, u bigint").parquet(path)


def running_sum(stream: DataFrame) -> DataFrame:
    return stream.groupBy("row_id").agg(F.sum("m").alias("m"), F.sum("u").alias("u"), F.count_if(F.col("m") + F.col("u") > 0).alias("n"))
