"""Numbers that run over a whole axis, found in blocks of rows: sums per block first, then an offset to each block's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block. The only table in one task has a row a block.
SIZE = 1 << 20


def _block(size: int) -> Column:
    return F.floor(F.col("row_id") / size).cast("bigint")


def running(df: DataFrame, amount: Column, name: str, size: int = SIZE) -> DataFrame:
    """df with the sum of amount over all rows up to this one by row_id. Row ids are distinct."""
    d = df.withColumn("block", _block(size)).withColumn("amount", amount)
    sums = d.groupBy("block").agg(F.sum("amount").alias("all"))
    start = sums.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("start"))
    own = F.sum("amount").over(Window.partitionBy("block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("own", own).join(start, "block").withColumn(name, F.col("own") + F.col("start")).drop("block", "amount", "own", "start")


def runs(df: DataFrame, column: str, size: int = SIZE) -> DataFrame:
    """df with run, the number of its run of rows with equal values of column; a value that reappears makes a new run."""
    d = df.withColumn("block", _block(size))
    last = d.groupBy("block").agg(F.max_by(F.struct(column), "row_id").alias("last"))
    before = last.select("block", F.lag("last").over(Window.orderBy("block")).alias("before"))
    order = Window.partitionBy("block").orderBy("row_id")
    d = d.withColumn("previous", F.lag(F.struct(column)).over(order)).join(before, "block")
    d = d.withColumn("previous", F.coalesce("previous", "before"))
    new = F.col("previous").isNull() | ~F.col("previous").getField(column).eqNullSafe(F.col(column))
    return running(d.withColumn("new", new.cast("bigint")).drop("block", "before", "previous"), F.col("new"), "run", size).drop("new")
