"""Near-duplicates by MinHash with tensored banding; every link is confirmed on full shingle sets.

Two collections of ``side`` keys are made from two min-hashes each; every pair of a key of the one and a key of the other
is the key of a table, so 4 * side min-hashes feed side * side tables. Documents with equal sets form classes, and only
classes go on. In a bucket, every class is compared with the first one, so groups of copies cost one comparison a member.
In buckets whose classes are not all connected after that, those apart from the first one are compared with all others: in
blocks of bounded size, which give links between components only, never all pairs. Buckets of equal members are opened once.

Texts are never shuffled: keys lone in their bucket go before the shuffle by a Bloom filter, sets are computed where texts
are read, again by a Bloom filter for those of compared classes only, and pairs are decided on full sets in their blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import Tables, arrow_map, bloom, materialize, mix, pieces, raw, shingles
from sitegrid.llm.components import components


#: Elements of sets in a block that is compared at once.
BLOCK = 1 << 18


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def table_keys(s: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set in side * side tables, and the keys of the first collection that they are made from."""
    a, b = _seeds(4 * side)
    low = np.full(4 * side, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 8192):
        low = np.minimum(low, (s[at : at + 8192, None] * a + b).min(axis=0))
    low = mix(low)
    left, right = mix(low[0 : 2 * side : 2] * np.uint64(3) + low[1 : 2 * side : 2]), mix(low[2 * side :: 2] * np.uint64(5) + low[2 * side + 1 :: 2])
    number = np.arange(side * side, dtype=np.uint64).reshape(side, side)
    return mix(left[:, None] + mix(right[None, :] + number)).ravel(), mix(left + np.arange(side, dtype=np.uint64))


def digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size and two 64-bit digests of each set, which tell classes apart."""
    n = pa.array([len(s) for s in sets], pa.int64())
    return n, *(pa.array([int(mix(s ^ np.uint64(x)).sum().view(np.int64)) for s in sets], pa.int64()) for x in (0, 0x5851F42D4C957F2D))


def _signatures(docs: DataFrame, k: int, side: int) -> DataFrame:
    """docs(id, th, rest, text) -> (id, th, rest, n, d1, d2, keys): keys of the tables, then of the first
    collection, of each set; none for empty sets and rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3, 1 << 20):
            sets = shingles(*raw(b.column(3)), k)
            keys = [np.concatenate(table_keys(s, side)).view(np.int64) if len(s) and i else np.zeros(0, np.int64) for s, i in zip(sets, b.column(0).is_valid().to_pylist(), strict=True)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *digests(sets), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys)))], names=["id", "th", "rest", "n", "d1", "d2", "keys"])

    return arrow_map(docs.select("id", "th", "rest", "text"), run, "id long, th long, rest long, n long, d1 long, d2 long, keys array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """texts(text) -> (n, d1, d2, s array<long>): full sets; most repeats within a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in pieces(batches, 0, 1 << 20):
            sets = shingles(*raw(b.column(0)), k)
            cols = digests(sets)
            new = []
            for i, d in enumerate(cols[1].to_pylist()):
                if len(sets[i]) and d not in seen:
                    new.append(i)
                    seen.add(d)
            if len(seen) > 100_000:
                seen.clear()
            if new:
                off = np.concatenate([[0], np.cumsum([len(sets[i]) for i in new])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(new)) for c in cols), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([sets[i] for i in new]).view(np.int64)))], names=["n", "d1", "d2", "s"])

    return arrow_map(texts, run, "n long, d1 long, d2 long, s array<long>")


def _compare(units: DataFrame, percent: int) -> DataFrame:
    """units(key, i, j, side, node, comp, s) -> links(a, b): in every unit (key, i, j), rows of side 0 with similar ones of side 1.

    For each row of side 0 and each component that it isn't in, one link is given, if there is any.
    """

    def close(left: list, right: list) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for _, _, s in right])
        names, at = np.unique(np.concatenate([s for _, _, s in right]), return_inverse=True)
        first, comps, nodes = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([c for _, c, _ in right]), np.array([i for i, _, _ in right])
        for i, comp, s in left:
            place = np.minimum(np.searchsorted(names, s), len(names) - 1)
            mine = np.zeros(len(names), np.int32)
            mine[place[names[place] == s]] = 1
            common = np.add.reduceat(mine[at], first)
            on = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (comps != comp))
            for j in on[np.unique(comps[on], return_index=True)[1]]:
                yield min(i, int(nodes[j])), max(i, int(nodes[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            pairs = sorted(set(close(*sides))) if sides[0] and sides[1] else []
            sides[0].clear()
            sides[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            unit = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            off, flat = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy()
            for n, (side, i, comp) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                if unit[n] != now:
                    if now is not None:
                        yield done()
                    now = unit[n]
                sides[side].append((i, comp, flat[off[n] : off[n + 1]].copy()))
        if now is not None:
            yield done()

    sorted_units = units.select("key", "i", "j", "side", "node", "comp", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return arrow_map(sorted_units, run, "a long, b long").distinct()


def _blocks(n: Column) -> Column:
    return F.ceil(F.sum(n) / BLOCK).cast("int")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Units of each bucket's first class and the others, by first class."""
    fits = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    pairs = members.where((F.col("node") != F.col("a")) & fits).select("a", "na", "node", "n").distinct()
    sized = pairs.join(pairs.groupBy("a").agg(_blocks(F.col("n")).alias("parts")), "a").withColumn("j", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    one = sized.select(F.col("a").alias("key"), F.lit(0).alias("i"), "j", F.lit(0).alias("side"), F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    return one.union(sized.select(F.col("a").alias("key"), F.lit(0).alias("i"), "j", F.lit(1).alias("side"), "node", F.col("node").alias("comp")))


def _opened(members: DataFrame, comp: DataFrame, written: Tables) -> DataFrame:
    """Units of buckets that still hold several components: whoever isn't with the first class against all others, block by block.

    Open buckets that share a key of the first collection are one unit, so that a set travels at most once for each of these.
    """
    held = members.where("c > 2").join(comp, members.node == comp.id, "left").select("key", "left", "a", "node", "n", F.coalesce("component", "node").alias("comp"))
    of_head = held.where("node = a").select("key", F.col("comp").alias("head_comp"))
    held = written(held.join(of_head, "key").select("key", "left", "node", "n", "comp", (F.col("node") == F.col("a")).alias("head"), (F.col("comp") != F.col("head_comp")).alias("stray")), "held")
    opened = held.groupBy("key").agg(F.max("stray").alias("open")).where("open").select("key")
    held = held.join(opened, "key").groupBy(F.col("left").alias("key"), "node", "n", "comp").agg(F.min("head").alias("head"), F.max("stray").alias("stray"))
    held = written(held, "open")
    sums = held.groupBy("key").agg(_blocks(F.when(F.col("stray"), F.col("n"))).alias("rows"), _blocks(F.col("n")).alias("cols"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node", "head", "stray")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node", "head", "stray")).alias("y"))
    once = sums.where("rows is not null").groupBy("c", "x", "y").agg(F.min(F.struct("key", "rows", "cols")).alias("s")).select("s.key", "s.rows", "s.cols")
    placed = written(held.join(once, "key").withColumn("place", F.xxhash64("node")), "placed")
    one = placed.where("stray").select("key", F.expr("cast(pmod(place, rows) as int)").alias("i"), F.explode(F.expr("sequence(0, cols - 1)")).alias("j"), F.lit(0).alias("side"), "node", "comp")
    two = placed.where("not head").select("key", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.expr("cast(pmod(place, cols) as int)").alias("j"), F.lit(1).alias("side"), "node", "comp")
    return one.union(two)


def _grouped(texts: DataFrame, k: int, percent: int, side: int, written: Tables) -> DataFrame:
    """texts(id, th, rest, text) -> (id, th, rest, n, group, component_id): group numbers near-duplicate groups; both null for
    rows that link with nothing by definition."""
    sig = written(_signatures(texts, k, side), "signatures")
    some = sig.where("n > 0 and id is not null")
    classes = some.groupBy("n", "d1", "d2").agg(F.first("keys").alias("keys"), F.min("id").alias("low"), F.min("th").alias("th"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # 64 table keys a class, each with its key of the first collection
    rows = classes.select("node", "n", "keys", F.posexplode(F.slice("keys", 1, side * side)).alias("at", "key"))
    rows = rows.select("node", "n", "key", F.get("keys", F.lit(side * side) + F.floor(F.col("at") / side).cast("int")).alias("left"))
    heads = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("c")).where("c > 1")
    heads = written(heads.select("key", F.col("head.node").alias("a"), F.col("head.n").alias("na"), "c"), "heads")
    bits, may = bloom(heads.select(F.col("key").alias("h")), heads.count())
    members = written(rows.where(may(bits, F.col("key"))).join(heads, "key"), "members")
    needed = written(members.select("node").distinct().join(classes.select("node", "n", "d1", "d2", "th"), "node"), "needed")
    bits, may = bloom(needed.select(F.col("th").alias("h")), needed.count())
    full = _sets(texts.where(may(bits, F.xxhash64("text"))).select("text"), k)
    sets = written(full.groupBy("n", "d1", "d2").agg(F.first("s").alias("s")).join(needed, ["n", "d1", "d2"]).select("node", "s"), "sets")
    links = written(_compare(_stars(members, percent).join(sets, "node"), percent), "links")
    units = written(_opened(members, components(links), written), "units")
    more = written(_compare(units.join(sets, "node"), percent), "more")
    comp = components(links.union(more))
    of = classes.select("n", "d1", "d2", "node", "low").join(comp, F.col("node") == F.col("id"), "left").select("n", "d1", "d2", "low", F.coalesce("component", "node").alias("group"))
    of = written(of, "of")
    lowest = of.groupBy("group").agg(F.min("low").alias("component_id"))
    of = of.join(lowest, "group").select("n", "d1", "d2", "group", "component_id")
    rest = sig.where("not (n > 0 and id is not null)").select("id", "th", "rest", "n", F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("component_id"))
    return some.join(of, ["n", "d1", "d2"]).select("id", "th", "rest", "n", "group", "component_id").unionByName(rest)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    every = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(docs.columns)))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), every.alias("rest"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, side: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row: near-duplicate groups of whole texts.

    Words are what blanks (space, tab to carriage return) separate, A-Z lower-cased; a document's set holds its distinct
    k-word shingles, or its whole sequence if it has fewer words. Documents with
    100 * intersection >= percent * union are linked. component_id: the smallest id that links reach; kept: it is the
    row's own. Null, empty and blank texts have no shingles and link with nothing. Ids are longs. Each row is treated by
    its own text, also where ids repeat; equal rows are in one group and get a row each. Rows without an id link with
    nothing, have no component and are kept. Other columns are ignored; an empty table gives an empty one. At a
    similarity of exactly 0.8, side 8 misses a pair of documents with probability 0.0006, and fewer above it.
    """
    with Tables(docs.sparkSession) as written:
        found = _grouped(_keyed(docs.select(id_col, text_col), id_col, text_col), k, percent, side, written)
        component = F.coalesce("component_id", "id")
        out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
        return materialize(out, "near")


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80, side: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, but one row only of each near-duplicate group: the one with the smallest id.

    Groups are those of near_duplicates. Rows that share an id go by their own texts; among rows of a group with the smallest
    id, a fixed one by hash stays, and one of wholly equal ones. Rows without an id or without words all stay. Only texts that
    a Bloom filter can't tell from lost ones are shuffled.
    """
    spark = docs.sparkSession
    with Tables(spark) as written:
        found = _grouped(_keyed(docs, id_col, text_col), k, percent, side, written).where("group is not null")
        each = written(found.groupBy("group", "id", "th", "rest").agg(F.count("*").alias("times")), "each")
        first = each.groupBy("group").agg(F.min(F.struct("id", "th", "rest")).alias("f")).select("f.*").withColumn("first", F.lit(True))
        lost = each.join(first, ["id", "th", "rest"], "left").select(F.xxhash64("id", "th", "rest").alias("h"), "id", "rest", F.coalesce("first", F.lit(False)).alias("first"), "times")
        lost = materialize(lost.where("not first or times > 1"), "lost")
    n = lost.count()
    every = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(docs.columns)))
    own = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col), every)
    if not n:
        return docs
    marked = docs.select("*", own.alias("lost key"))
    bits, test = bloom(lost.select("h"), n)
    may = lambda h: test(bits, h)
    hit = marked.where(F.col(id_col).isNotNull() & may(F.col("lost key"))).join(lost.select(F.col("h").alias("lost key"), F.col("first").alias("lost first")), "lost key", "left")
    once = hit.where("`lost first`").select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates()
    passed = hit.where("`lost first` is null").unionByName(marked.where(F.col(id_col).isNull() | ~may(F.col("lost key"))), allowMissingColumns=True)
    return passed.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(once)
