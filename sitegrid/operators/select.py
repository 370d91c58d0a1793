"""Choosing samples and rows, masks, and conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.functions.scalars import beta, char_bit, coordinate_parts
from sitegrid.operators.blocks import running


def _as_bit(df: DataFrame, kind: str) -> Column:
    return {"bits": F.col("bit"), "chars": char_bit(F.col("ch")) if "ch" in df.columns else None, "mu": (F.col("m") + F.col("u") > 0) if "m" in df.columns else None}[kind]


def to_bits(df: DataFrame, kind: str) -> DataFrame:
    if kind not in ("bits", "chars", "mu"):
        raise ValueError(f"{kind} can't be cast to bits")
    return df.select("sample", "row_id", _as_bit(df, kind).alias("bit"))


def binarize(mu: DataFrame, threshold: float = 0.5, min_cov: int = 1, min_m: int = 0) -> DataFrame:
    """Set and universe of counts: level at least threshold, or at least min_m methylated reads if that is over 0."""
    uni = F.col("m") + F.col("u") >= min_cov
    hit = F.col("m") >= min_m if min_m > 0 else F.coalesce(beta(F.col("m"), F.col("u")) >= threshold, F.lit(False))
    return mu.select("sample", "row_id", (uni & hit).alias("in_set"), uni.alias("in_uni"))


def mask(df: DataFrame, kind: str, by: DataFrame, invert: bool = False, contextualize: bool = False, strict: bool = False) -> DataFrame:
    """df under the mask by(row_id, bit). strict: unequal numbers of rows are an error.

    Counts and bits are cleared where the mask is on; sets keep only what the mask has on. contextualize makes bits a
    set in the mask as universe.
    """
    if kind not in ("mu", "su", "bits", "chars"):
        raise ValueError(f"{kind} can't be masked")
    if strict:
        same_axis(df, by)
    bit = ~F.col("mask_bit") if invert else F.col("mask_bit")
    d = df.join(by.select("row_id", F.col("bit").alias("mask_bit")), "row_id")
    if kind == "mu":
        return d.select("sample", "row_id", *(F.when(bit, 0).otherwise(F.col(c)).alias(c) for c in ("m", "u")))
    if kind == "su":
        return d.select("sample", "row_id", (F.col("in_set") & F.col("in_uni") & bit).alias("in_set"), (F.col("in_uni") & bit).alias("in_uni"))
    own = _as_bit(df, kind)
    return d.select("sample", "row_id", (own & bit).alias("in_set"), bit.alias("in_uni")) if contextualize else d.select("sample", "row_id", (own & ~bit).alias("bit"))


def index(df: DataFrame, names: list[str] | DataFrame | None = None) -> DataFrame:
    """samples(sample, ord): the tracks' names in order, 0-based.

    names: a list in its own order, or a table in the order of its ord, or of its names if it has none. Tracks that a list
    leaves out are called Unnamed_1 and so on, in order; a name that is given twice, or more names than tracks, is an error.
    """
    if isinstance(names, list):
        if len(set(names)) < len(names):
            raise ValueError("a name is given twice")
        tracks = df.select("sample").distinct().count()
        if len(names) > tracks:
            raise ValueError(f"{len(names)} names for {tracks} tracks")
        every = names + [f"Unnamed_{i + 1}" for i in range(len(names), tracks)]
        return df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(every)], "sample string, ord bigint")
    s = df.select("sample").distinct() if names is None else names
    by = "ord" if "ord" in s.columns else "sample"
    return s.select("sample", (F.row_number().over(Window.orderBy(by)) - 1).cast("bigint").alias("ord"))


def subset(df: DataFrame, samples: DataFrame, names: list[str] | None = None, head: int | None = None, tail: int | None = None) -> DataFrame:
    """Tracks of the named samples, in that order as ord; else of the first or last ones by samples(sample, ord)."""
    spark = df.sparkSession
    if names:
        want = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "sample string, ord bigint")
        lost = want.join(samples.select("sample"), "sample", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"no sample {lost[0].sample}")
    elif tail is not None:
        want = samples.orderBy(F.desc("ord")).limit(tail)
    else:
        want = samples.orderBy("ord").limit(1 if head is None else head)
    return df.join(want.select("sample", "ord"), "sample")


def subset_states(states: DataFrame, terms: list[str]) -> DataFrame:
    """One bit track for each term."""
    if len(set(terms)) < len(terms):
        raise ValueError("a term is given twice")
    found = {r.state for r in states.where(F.col("state").isin(terms)).select("state").distinct().collect()}
    if lost := [t for t in terms if t not in found]:
        raise ValueError(f"no state {lost[0]}")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("sample"), (F.col("state") == t).alias("bit")) for t in terms)))
    return states.select("row_id", each.alias("x")).select("x.sample", "row_id", "x.bit")


def rows_by_index(df: DataFrame, indices: list[int]) -> DataFrame:
    """Rows by 1-based index, in the given order and as often; row_id is the place in the list."""
    want = df.sparkSession.createDataFrame([(i - 1, p) for p, i in enumerate(indices)], "row_id bigint, place bigint")
    return df.join(F.broadcast(want), "row_id").withColumn("row_id", F.col("place")).drop("place")


def rows_by_name(df: DataFrame, sites: DataFrame, names: list[str]) -> DataFrame:
    """Rows by chrom_beg1, in the given order; an unknown coordinate is an error."""
    want = df.sparkSession.createDataFrame([(n, p) for p, n in enumerate(names)], "name string, place bigint")
    chrom, pos = coordinate_parts(F.col("name"))
    found = want.select(chrom.alias("chrom"), pos.alias("beg1"), "place", "name").join(sites, ["chrom", "beg1"], "left")
    lost = found.where("row_id is null").limit(1).collect()
    if lost:
        raise ValueError(f"no site {lost[0].name}")
    return df.join(found.select("row_id", "place"), "row_id").withColumn("row_id", F.col("place")).drop("place")


def rows_by_mask(df: DataFrame, by: DataFrame) -> DataFrame:
    """Rows where the mask is on; row_id counts these rows."""
    on = running(by.where("bit").select("row_id"), F.lit(1).cast("bigint"), "count").select("row_id", (F.col("count") - 1).cast("bigint").alias("new_id"))
    return df.join(on, "row_id").withColumn("row_id", F.col("new_id")).drop("new_id")


def rows_between(df: DataFrame, beg0: int = 0, end1: int | None = 2) -> DataFrame:
    """Rows beg0 to end1 - 1, numbered from 0; one row if end1 is None."""
    return df.where(F.col("row_id").between(beg0, beg0 if end1 is None else end1 - 1)).withColumn("row_id", F.col("row_id") - beg0)


def row_block(df: DataFrame, block: int, size: int = 1_000_000) -> DataFrame:
    return rows_between(df, block * size, (block + 1) * size)


def region(sites: DataFrame, where: str) -> DataFrame:
    """Sites of chr or chr:beg-end, 1-based and inclusive; commas in numbers are allowed."""
    chrom, _, span = where.partition(":")
    s = sites.where(F.col("chrom") == chrom)
    if span:
        beg, end = (int(x.replace(",", "")) for x in span.split("-"))
        if beg < 1 or end < beg:
            raise ValueError(f"no region: {where}")
        s = s.where(F.col("beg1").between(beg, end))
    return s


def chunk(df: DataFrame, size: int = 1_000_000) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("row_id") / size))


def info(df: DataFrame, kind: str) -> DataFrame:
    """(sample, n_rows, format, n_keys) of tracks."""
    keys = F.count_distinct("state") if kind == "states" else F.lit(None).cast("bigint")
    return df.groupBy("sample").agg(F.count("*").alias("n_rows"), F.lit(kind).alias("format"), keys.alias("n_keys"))


#: The one-character code of each kind, and the bytes of a value of it where its rows don't tell.
FORMATS = {"bits": ("0", 1), "chars": ("1", 1), "states": ("2", 0), "mu": ("3", 0), "betas": ("4", 4), "ternary": ("5", 4), "su": ("6", 2), "sites": ("7", 1)}


def keys_text(states: DataFrame, width: int = 25) -> DataFrame:
    """(sample, keys): how many keys and the first of them by first appearance; once there are over width characters, an ellipsis."""
    k = states.groupBy("sample", "state").agg(F.min("row_id").alias("first"))  # keys are categories: a bounded list
    of = Window.partitionBy("sample")
    k = k.withColumn("n", F.count("*").over(of)).withColumn("head", F.concat(F.lit("N="), F.col("n"), F.lit("|")))
    before = F.sum(F.length("state") + 1).over(of.orderBy("first", "state").rowsBetween(Window.unboundedPreceding, -1))
    k = k.withColumn("before", F.length("head") + F.coalesce(before - 1, F.lit(0)))
    shown = F.array_sort(F.collect_list(F.when(F.col("before") <= width, F.struct("first", "state"))))
    g = k.groupBy("sample", "head").agg(F.first("n").alias("n"), shown.alias("shown"))
    text = F.concat("head", F.array_join(F.transform("shown", lambda x: x.state), ","), F.when(F.size("shown") < F.col("n"), ",...").otherwise(""))
    return g.select("sample", text.alias("keys"))


def describe(df: DataFrame, kind: str, samples: DataFrame | None = None, file: str = "-") -> DataFrame:
    """(file, sample, n_col, n_rows, format, unit_bytes, keys) of tracks.

    samples(sample, ord) is their index: n_col is its size, "NA" without one; samples then have their place by name from 1 on.
    A track that the index lacks is an error. unit_bytes is 0 where a value's size depends on the rows' text.
    """
    code, unit = FORMATS[kind]
    d = df.groupBy("sample").agg(F.count("*").alias("n_rows"))
    if kind == "mu":
        d = d.join(max_unit(df).withColumnRenamed("unit", "unit_bytes"), "sample")
    else:
        d = d.withColumn("unit_bytes", F.lit(unit))
    d = d.join(keys_text(df), "sample", "left") if kind == "states" else d.withColumn("keys", F.lit("NA"))
    if samples is None:
        d = d.withColumn("n_col", F.lit("NA")).withColumn("sample", F.row_number().over(Window.orderBy("sample")).cast("string"))  # one row a track
    else:
        n = samples.agg(F.count("*").cast("string").alias("n_col"))
        d = d.join(samples.select("sample", "ord"), "sample", "left").crossJoin(F.broadcast(n))  # one row
        d = d.withColumn("sample", F.when(F.col("ord").isNull(), F.raise_error(F.concat(F.lit("not in the index: "), "sample")).cast("string")).otherwise(F.col("sample")))
    return d.select(F.lit(file).alias("file"), "sample", "n_col", "n_rows", F.lit(code).alias("format"), F.col("unit_bytes").cast("int").alias("unit_bytes"), "keys")


def choose_rows(
    df: DataFrame,
    sites: DataFrame | None = None,
    names: list[str] | None = None,
    indices: list[int] | None = None,
    by: DataFrame | None = None,
    beg0: int | None = None,
    end1: int | None = None,
    block: int | None = None,
    size: int = 1_000_000,
    coordinates: bool = False,
) -> DataFrame:
    """Rows by the first way that is given: names or indices, a mask, a range or block, else the first two rows.

    A list of names needs sites. coordinates: the rows' chrom and beg1, chosen alike, come along.
    """
    if (names is not None or coordinates) and sites is None:
        raise ValueError("names and coordinates need sites")

    def chosen(d: DataFrame) -> DataFrame:
        if indices is not None:
            return rows_by_index(d, indices)
        if names is not None:
            return rows_by_name(d, sites, names)
        if by is not None:
            return rows_by_mask(d, by)
        if beg0 is not None:
            return rows_between(d, beg0, end1)
        return rows_between(d) if block is None else row_block(d, block, size)

    if not coordinates:
        return chosen(df)
    if names is None:
        return chosen(df.join(sites.select("row_id", "chrom", "beg1"), "row_id"))
    # rows_by_name joins with sites' own columns
    return chosen(df.join(sites.select("row_id", F.col("chrom").alias("site_chrom"), F.col("beg1").alias("site_beg1")), "row_id")).withColumnsRenamed({"site_chrom": "chrom", "site_beg1": "beg1"})


def same_axis(*tracks: DataFrame) -> None:
    """An error unless all samples of all tracks have the same number of rows. It reads their row ids once."""
    sizes = [t.groupBy(*([F.col("sample")] if "sample" in t.columns else [])).agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high")).first() for t in tracks]
    ends = {x for r in sizes for x in (r.low, r.high) if x is not None}
    if len(ends) > 1:
        raise ValueError(f"tracks of {min(ends)} and of {max(ends)} rows")


def split_names(samples: DataFrame, prefix: str | None = None, named: bool = True) -> DataFrame:
    """(sample, file): the file that each track of samples(sample, ord) goes to, by its name or by its 1-based place."""
    head = F.lit("" if prefix is None else prefix if named else f"{prefix}_")
    own = F.col("sample") if named else F.concat(F.lit("split_"), F.col("ord") + 1)
    return samples.select("sample", F.concat(head, own, F.lit(".cx")).alias("file"))


def append_index(samples: DataFrame, name: str) -> DataFrame:
    """samples(sample, ord) with one more name at the end; a name that is there already is an error."""
    if samples.where(F.col("sample") == name).limit(1).collect():
        raise ValueError(f"sample {name} is there already")
    return samples.union(samples.agg(F.lit(name).alias("sample"), F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord")))


def require_axis(df: DataFrame, n_rows: int) -> None:
    """An error unless every track has n_rows rows."""
    bad = df.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") != n_rows).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].sample} has {bad[0].n} rows, not {n_rows}")


def chrom_codes(sites: DataFrame) -> DataFrame:
    """(row_id, chrom_id, pos): coordinates with chromosomes numbered from 0 by first appearance."""
    first = sites.groupBy("chrom").agg(F.min("row_id").alias("first"))  # one row a chromosome
    codes = first.select("chrom", (F.row_number().over(Window.orderBy("first")) - 1).alias("chrom_id"))
    return sites.join(codes, "chrom").select("row_id", "chrom_id", (F.col("beg1") + 1).alias("pos"))


def max_unit(mu: DataFrame) -> DataFrame:
    """(sample, unit): how many bytes, of 1, 2, 4 and 8, hold both counts of every row without halving any."""
    most = F.max(F.greatest("m", "u"))
    return mu.groupBy("sample").agg(F.when(most < 15, 1).when(most < 255, 2).when(most < 65_535, 4).otherwise(8).alias("unit"))


def state_keys(states: DataFrame) -> DataFrame:
    """(state, first_row, n): keys by first appearance."""
    return states.groupBy("state").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n"))
