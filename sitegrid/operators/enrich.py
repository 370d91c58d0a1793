"""Enrichment statistics of 2 x 2 tables (nu universe, nd and nq sizes, ndq overlap)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(1)
def _lgamma():
    return np.frompyfunc(math.lgamma, 1, 1)


def _choose(n, k):
    g = _lgamma()
    return (g(n + 1.0) - g(k + 1.0) - g(n - k + 1.0)).astype(float)


def tail(nu: int, nd: int, nq: int, ndq: int) -> tuple[float, float]:
    """P(X >= ndq) and P(X <= ndq) for X hypergeometric, summed from log terms block by block."""
    low, high, whole = max(0, nd + nq - nu), min(nd, nq), math.lgamma(nu + 1) - math.lgamma(nd + 1) - math.lgamma(nu - nd + 1)

    def total(a: int, b: int, down: bool) -> float:
        out = 0.0
        for at in range(0, max(0, b - a + 1), 4096):
            x = np.arange(max(a, b - at - 4095), b - at + 1, dtype=float) if down else np.arange(a + at, min(b, a + at + 4095) + 1, dtype=float)
            part = float(np.exp(_choose(float(nq), x) + _choose(float(nu - nq), nd - x) - whole).sum())
            out += part
            if part <= out * 1e-17:
                break
        return min(1.0, out)

    return (1.0 if ndq <= low else total(ndq, high, False)), (1.0 if ndq >= high else total(low, ndq, True))


def enrich(df: DataFrame) -> DataFrame:
    """df(nu, nd, nq, ndq, ...) with p_greater, p_less, p_two_sided, log2_or, jaccard, overlap, npmi, dice."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    @F.pandas_udf(StructType([StructField("g", DoubleType()), StructField("l", DoubleType())]))
    def tails(nu: pd.Series, nd: pd.Series, nq: pd.Series, ndq: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tail(*map(int, x)) for x in zip(nu, nd, nq, ndq, strict=True)], columns=["g", "l"])

    nu, nd, nq, ndq = (F.col(c).cast("double") for c in ("nu", "nd", "nq", "ndq"))
    a, b = ndq * (nu - nd - nq + ndq), (nd - ndq) * (nq - ndq)
    odds = F.when(b == 0, F.lit(1.7976931348623157e308)).when(a == 0, F.lit(2.2250738585072014e-308)).otherwise(a / F.when(b != 0, b))
    return df.withColumn("t", tails("nu", "nd", "nq", "ndq")).select(
        *df.columns, F.col("t.g").alias("p_greater"), F.col("t.l").alias("p_less"), F.least(F.lit(1.0), 2 * F.least("t.g", "t.l")).alias("p_two_sided"), F.log2(odds).alias("log2_or"),
        (ndq / F.nullif(nd + nq - ndq, F.lit(0.0))).alias("jaccard"), (ndq / F.nullif(F.least(nd, nq), F.lit(0.0))).alias("overlap"),
        ((F.log2(nd) + F.log2(nq) - 2 * F.log2(nu)) / F.nullif(F.log2(ndq) - F.log2(nu), F.lit(0.0)) - 1).alias("npmi"), (2 * ndq / F.nullif(nd + nq, F.lit(0.0))).alias("dice"),
    )


def tables(lines: DataFrame) -> DataFrame:
    """Lines `value` of tab-separated nu, nd, nq, ndq and any further columns, as (nu, nd, nq, ndq, rest); a line with less than
    four counts is an error."""
    f = F.split("value", "\t", 5)
    count = lambda i: F.when(F.try_element_at(f, F.lit(i + 1)).rlike("^[0-9]+$"), F.try_element_at(f, F.lit(i + 1)).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not four counts: "), "value")).cast("bigint"))
    return lines.select(*(count(i).alias(c) for i, c in enumerate(("nu", "nd", "nq", "ndq"))), F.try_element_at(f, F.lit(5)).alias("rest"))


def enrich_file(spark: SparkSession, path: str) -> DataFrame:
    """enrich of a text file of tables."""
    return enrich(tables(spark.read.text(path)))
