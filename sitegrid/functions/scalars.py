"""Scalar expressions; a missing value is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def cov(m: Column, u: Column) -> Column:
    return m + u


def beta(m: Column, u: Column) -> Column:
    """M / (M + U); NULL without reads."""
    return m / F.when(m + u != 0, m + u)


def log2_odds(nu: Column, nq: Column, nm: Column, no: Column) -> Column:
    """log2 of the odds ratio of a 2 x 2 table. +-inf where one side is empty; NULL where both are or a cell is negative."""
    nu, nq, nm, no = (x.cast("double") for x in (nu, nq, nm, no))
    num, den = (nu - nq - nm + no) * no, (nq - no) * (nm - no)
    return F.when((num > 0) & (den > 0), F.log2(num / F.when(den > 0, den))).when((num > 0) & (den == 0), F.lit(INF)).when((num == 0) & (den > 0), F.lit(-INF))


def fit_mu(m: Column, u: Column, nbits: int) -> Column:
    """(m, u) halved together until both are under 2 ** nbits - 1."""
    most, top = F.greatest(m, u), (1 << nbits) - 1
    k = F.size(F.filter(F.sequence(F.lit(0), F.lit(63 - nbits)), lambda i: F.expr("0") + F.call_function("shiftright", most, i) >= top)).cast("int")
    return F.struct(F.call_function("shiftright", m, k).alias("m"), F.call_function("shiftright", u, k).alias("u"))


def packed_mu(m: Column, u: Column) -> Column:
    return F.shiftleft(m.cast("bigint"), 32) + u


def code2(in_set: Column, in_uni: Column) -> Column:
    return in_set.cast("int") + 2 * in_uni.cast("int")


def coordinate(chrom: Column, beg1: Column) -> Column:
    return F.concat_ws("_", chrom, beg1)


def coordinate_parts(name: Column) -> tuple[Column, Column]:
    """Chromosome and position of chrom_beg1, split at the last underscore."""
    pos = F.substring_index(name, "_", -1)
    return F.left(name, F.length(name) - F.length(pos) - 1), pos.cast("bigint")


def level(b: Column) -> Column:
    """H, M or L."""
    return F.when(b > 0.67, "H").when(b > 0.33, "M").when(b.isNotNull(), "L").otherwise(".")


def decile(b: Column) -> Column:
    return F.least(F.lit(9), F.floor(b * 10)).cast("int")


def char_bit(ch: Column) -> Column:
    """The cast of a character to a bit: bytes above '0'."""
    return F.ascii(ch) > 48
