"""Text views: unpacked values, and levels in windows of a region or of all chromosomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.scalars import beta, code2, decile, level, packed_mu
from sitegrid.operators.blocks import runs


def value(kind: str, n: int = 0) -> Column:
    """A track's value as text. n = 0: packed; n < 0: both parts; n > 0: level with at least n reads, or 2-bit code."""
    m, u, s, uni = F.col("m"), F.col("u"), F.col("in_set"), F.col("in_uni")
    if kind == "mu":
        if n == 0:
            return packed_mu(m, u).cast("string")
        if n < 0:
            return F.concat_ws("\t", m, u)
        return F.when((m + u > 0) & (m + u >= n), F.format_string("%.3f", beta(m, u))).otherwise("NA")
    if kind == "su":
        if n == 0:
            return F.when(~uni, "2").when(s, "1").otherwise("0")
        return F.when(~uni, "NA\t0").otherwise(F.concat(s.cast("int"), F.lit("\t1"))) if n < 0 else code2(s, uni).cast("string")
    if kind == "betas":
        return F.when(F.col("beta") >= 0, F.format_string("%.3f", F.col("beta"))).otherwise("NA")
    return {"bits": F.col("bit").cast("int").cast("string"), "chars": F.col("ch"), "states": F.col("state")}[kind]


def unpack(df: DataFrame, kind: str, samples: list[str], n: int = 0) -> DataFrame:
    """One row for each site, one text column for each of the named samples."""
    return df.where(F.col("sample").isin(samples)).select("row_id", "sample", value(kind, n).alias("x")).groupBy("row_id").pivot("sample", samples).agg(F.first("x"))


def with_coordinates(wide: DataFrame, sites: DataFrame, style: int = 0) -> DataFrame:
    """Unpacked rows with their coordinate as a first text column."""
    return coordinate_text(sites, style).withColumnRenamed("text", "coordinate").join(wide, "row_id")


def coordinate_text(sites: DataFrame, style: int = 0) -> DataFrame:
    """(row_id, text): begin and end, 0-based, of two bases (0) or one (1), or chrom_beg1."""
    c, b = F.col("chrom"), F.col("beg1")
    return sites.select("row_id", (F.concat_ws("\t", c, b - 1, b + 1) if style == 0 else F.concat_ws("\t", c, b - 1, b) if style == 1 else F.concat_ws("_", c, b)).alias("text"))


def _level_of(kind: str) -> Column:
    if kind not in ("mu", "betas", "su", "bits"):
        raise ValueError(f"{kind} has no level")
    return {"mu": beta(F.col("m"), F.col("u")), "betas": F.col("beta"), "su": F.when(F.col("in_uni"), F.col("in_set").cast("double")), "bits": F.col("bit").cast("double")}[kind]


def _line(windows: DataFrame, keys: list[str], deciles: bool) -> DataFrame:
    glyph = F.coalesce(decile(F.col("b")).cast("string"), F.lit(".")) if deciles else level(F.col("b"))
    return windows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", glyph.alias("g")))), lambda x: x.g), "").alias("line"))


def region_view(df: DataFrame, kind: str, sites: DataFrame, max_cols: int = 80, deciles: bool = False) -> DataFrame:
    """(sample, line): mean levels of the sites' rows in at most max_cols windows of equally many rows."""
    span = sites.agg(F.min("row_id").alias("first"), F.count("*").alias("n")).withColumn("win", F.when(F.col("n") > max_cols, F.ceil(F.col("n") / max_cols)).otherwise(1))
    d = df.join(sites.select("row_id"), "row_id").crossJoin(F.broadcast(span)).select("sample", F.floor((F.col("row_id") - F.col("first")) / F.col("win")).alias("w"), _level_of(kind).alias("b"))
    return _line(d.groupBy("sample", "w").agg(F.avg("b").alias("b")), ["sample"], deciles)


def genome_view(df: DataFrame, kind: str, sites: DataFrame, max_cols: int = 80, deciles: bool = False) -> DataFrame:
    """(sample, chrom, line): the same over all chromosomes; no window crosses from one to another."""
    runs = sites.groupBy("chrom").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("win", F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy()) / max_cols)))
    d = df.join(sites.select("row_id", "chrom"), "row_id").join(runs, "chrom").select("sample", "chrom", F.floor((F.col("row_id") - F.col("first")) / F.col("win")).alias("w"), _level_of(kind).alias("b"))
    return _line(d.groupBy("sample", "chrom", "w").agg(F.avg("b").alias("b")), ["sample", "chrom"], deciles)


def chrom_runs(sites: DataFrame) -> DataFrame:
    """(chrom, first_row, last_row, n) of each run; a chromosome that reappears makes a row again."""
    return runs(sites.select("row_id", "chrom"), "chrom").groupBy("run", "chrom").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n")).drop("run")


#: Colours of ten levels from low to high, as numbers of the 256-colour terminal palette.
LEVEL_COLOURS = (21, 27, 33, 39, 45, 231, 224, 217, 210, 196)


def glyph(kind: str, deciles: bool = False, colour: bool = False) -> Column:
    """A site's own character: sets are full, light or a dot outside the universe; bits 1 or 0; levels a letter or their decile.

    colour puts the decile's colour around levels' deciles.
    """
    if kind == "su":
        return F.when(~F.col("in_uni"), ".").when(F.col("in_set"), "\u2588").otherwise("\u2591")
    if kind == "bits":
        return F.col("bit").cast("int").cast("string")
    b = _level_of(kind)
    if not deciles:
        return level(b)
    tenth = F.when(b.isNotNull(), F.greatest(F.lit(0), decile(b)))
    text = tenth.cast("string")
    if colour:
        shade = F.element_at(F.array(*(F.lit(c) for c in LEVEL_COLOURS)), tenth + 1)
        text = F.concat(F.lit("\x1b[38;5;"), shade, F.lit("m"), text, F.lit("\x1b[0m"))
    return F.coalesce(text, F.lit("."))


def lines(df: DataFrame, text: Column, size: int = 1 << 20) -> DataFrame:
    """(sample, block, line): the rows' texts one after another, in blocks of rows, so that no line holds a whole axis."""
    d = df.select("sample", F.floor(F.col("row_id") / size).cast("bigint").alias("block"), "row_id", text.alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("row_id", "x")))
    return d.groupBy("sample", "block").agg(F.array_join(F.transform(ordered, lambda r: r.x), "").alias("line"))


def site_view(df: DataFrame, kind: str, sites: DataFrame, deciles: bool = False, colour: bool = False) -> DataFrame:
    """(sample, block, line): a character for each of the sites' rows."""
    return lines(df.join(sites.select("row_id"), "row_id"), glyph(kind, deciles, colour))


def dump(su: DataFrame) -> DataFrame:
    """(sample, block, line): whole tracks of sets as 1, 0, and 2 outside the universe."""
    return lines(su, value("su"))


def unpack_chosen(df: DataFrame, kind: str, samples: DataFrame, names: list[str] | None = None, everything: bool = False, head: int | None = None, tail: int | None = None, n: int = 0) -> DataFrame:
    """unpack of the named samples; else of all, of the first or of the last ones by samples(sample, ord); else of the first."""
    if names is None:
        order = samples.orderBy(F.desc("ord") if not everything and head is None and tail is not None else F.asc("ord"))
        if not everything:
            order = order.limit(head if head is not None else tail if tail is not None else 1)
        names = [r.sample for r in sorted(order.collect(), key=lambda r: r.ord)]  # they become columns
    elif lost := set(names) - {r.sample for r in samples.where(F.col("sample").isin(names)).collect()}:
        raise ValueError(f"no sample {min(lost)}")
    return unpack(df, kind, names, n)


def header(samples: list[str], coordinates: int = 0) -> str:
    """The first line of unpacked text: names of the coordinate's columns (3 or 1, or none) and of the samples."""
    at = {0: [], 1: ["chrm_beg1"], 3: ["chrm", "beg0", "end1"]}[coordinates]
    return "\t".join([*at, *samples])
