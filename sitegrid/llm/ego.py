"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to unit length, so cosine >= t means a distance of at most eps = sqrt(2 - 2 t). A rotation onto principal
axes, fitted on a bounded sample, keeps distances, and no projection makes them longer; grid cells of side eps on the
leading axes therefore bound them from below. Vectors are sorted by label and cells and cut into sequence intervals, the
leaves of a tree whose nodes are longer intervals with bounding boxes. The join starts at the root's pair with itself and
goes down level by level: pairs of intervals whose labels differ or whose boxes are farther apart than eps are skipped,
the others are replaced by the pairs of their parts. Pairs of leaves are compared by matrix products.

Equal vectors form classes first. A pair of leaves gives each class's number of links and the edges of a spanning forest,
never all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrid.llm.common import materialize
from sitegrid.llm.components import components


def usable(v: Column) -> Column:
    """Whether a vector takes part: no null, NaN or infinite component, and not all zero."""
    ok = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as float64 rows."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled down first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True) if m.size else m
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if m.size else m


def _axes(sample: np.ndarray, n: int) -> np.ndarray:
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :n].copy()


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its component) of a bipartite links matrix."""
    i, j = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(i):
        return []
    m, a, b = links[np.ix_(i, j)], left[i].copy(), right[j].copy()
    top = np.iinfo(np.int64).max
    while True:
        x = np.minimum(a, np.where(m, b[None, :], top).min(1))
        y = np.minimum(b, np.where(m, x[:, None], top).min(0))
        if (x == a).all() and (y == b).all():
            break
        a, b = x, y
    return list({(int(p), int(q)) for p, q in [*zip(left[i], a, strict=True), *zip(right[j], b, strict=True)] if p != q})


def near_vectors(vectors: DataFrame, threshold: float = 0.98, axes: int = 6, leaf: int = 256, fan: int = 8, sample: int = 4000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Rows with equal, non-null labels whose vectors have a cosine of at least threshold, in double precision, are linked. Null
    vectors, all-zero ones, and those that hold null or non-finite components link with nothing; nor do vectors of
    different lengths. n_links counts other rows; component_id is the smallest id that links reach; kept: it is the row's
    own. Ids are longs; repeated rows are one vector and get a row each; rows without an id link with nothing, have no
    component and are kept. Other columns are ignored; an empty table gives an empty one.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-9
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.concat_ws(":", F.size(vector_col), F.col(label_col).cast("string")).alias("label"), F.col(vector_col).alias("v"), (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col))).alias("ok"))
    keyed = materialize(d.withColumn("key", F.when(F.col("ok"), F.sha2(F.concat(F.col("label"), F.lit("|"), F.to_json(F.col("v").cast("array<double>"))), 256))), "keyed")
    many = keyed.where("ok").groupBy("key").agg(F.count_distinct("id").alias("many"))
    classes = keyed.where("ok").groupBy("key").agg(F.min("id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes.join(many, "key"), "classes")
    some = {}
    for r in classes.select("v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toLocalIterator():
        some.setdefault(len(r.v), []).append(r.v)
    turn = {n: _axes(unit(np.array(m, np.float64)), axes) for n, m in some.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(1)
            cells = [[0] * axes] * len(vs)
            size = np.array(vs.value_lengths().to_pylist())
            for n in set(size.tolist()) & set(turn):
                at = np.flatnonzero(size == n)
                for i, c in zip(at, np.floor(unit(matrix(vs.take(pa.array(at)))) @ turn[n] / eps).astype(int), strict=True):
                    cells[i] = [*c.tolist(), *[0] * (axes - len(c))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(cells, pa.list_(pa.int32()))], names=["rep", "v", "many", "label", "cells"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = materialize(classes.select("rep", "v", "many", "label").mapInArrow(place, f"rep long, v {kind}, many long, label string, cells array<int>"), "placed")
    total = placed.count()
    runs = max(1, -(-total // (leaf * fan)))
    order = ["label", *(F.col("cells")[i] for i in range(axes)), "rep"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's rows, sorted, as leaves: one row each, with box and rows."""
        held: list = []
        run, number = None, 0

        def out() -> pa.RecordBatch:
            nonlocal number
            cells = np.array([r[4] for r in held])
            row = {"run": run, "leaf": run * (1 << 32) + number, "lo_label": held[0][3], "hi_label": held[-1][3], "lo": cells.min(0).tolist(), "hi": (cells.max(0) + 1).tolist(), "rows": [{"rep": r[0], "v": r[1], "many": r[2], "label": r[3]} for r in held]}
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=shape)

        shape = pa.schema([("run", pa.int64()), ("leaf", pa.int64()), ("lo_label", pa.string()), ("hi_label", pa.string()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("rows", pa.list_(pa.struct([("rep", pa.int64()), ("v", pa.list_(inner)), ("many", pa.int64()), ("label", pa.string())])))])
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                run = r[5]
                held.append(r)
                if len(held) == leaf:
                    yield out()
        if held:
            yield out()

    inner = pa.float32() if "float" in kind else pa.float64()
    leaves = materialize(placed.repartitionByRange(runs, *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id().cast("long")).mapInArrow(cut, f"run long, leaf long, lo_label string, hi_label string, lo array<int>, hi array<int>, rows array<struct<rep:long,v:{kind},many:long,label:string>>"), "leaves")
    # the tree: level 0 leaves, 1 runs, then groups of fan runs
    boxes = [F.min("lo_label").alias("lo_label"), F.max("hi_label").alias("hi_label"), F.array(*(F.min(F.col("lo")[i]) for i in range(axes))).alias("lo"), F.array(*(F.max(F.col("hi")[i]) for i in range(axes))).alias("hi")]
    levels = [materialize(leaves.select(F.col("leaf").alias("node"), F.col("run").alias("up"), "lo_label", "hi_label", "lo", "hi"), "level")]
    parts = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        levels.append(materialize(levels[-1].groupBy(F.col("up").alias("node")).agg(*boxes).withColumn("up", F.floor(F.col("node") / fan)), "level"))
        if parts <= 1:
            break
        parts = -(-parts // fan)
    side = lambda df, s: df.select(*(F.col(c).alias(c + s) for c in ("node", "up", "lo_label", "hi_label", "lo", "hi")))
    apart = sum((F.pow(F.greatest(F.lit(0), F.col("lo_1")[i] - F.col("hi_2")[i], F.col("lo_2")[i] - F.col("hi_1")[i]).cast("double"), 2) for i in range(axes)), F.lit(0.0))
    pairs = levels[-1].select(F.col("node").alias("p"), F.col("node").alias("q"))
    for level in levels[-2::-1]:
        down = pairs.join(side(level, "_1"), F.col("p") == F.col("up_1")).join(side(level, "_2"), F.col("q") == F.col("up_2"))
        down = down.where((F.col("node_1") <= F.col("node_2")) & (F.col("lo_label_1") <= F.col("hi_label_2")) & (F.col("lo_label_2") <= F.col("hi_label_1")) & (apart <= 1.0))
        pairs = materialize(down.select(F.col("node_1").alias("p"), F.col("node_2").alias("q")), "pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(len(big)):
                b = big.slice(at, 1)
                same = b.column(0)[0].as_py() == b.column(1)[0].as_py()
                x, y = (b.column(c).flatten() for c in (2, 3))
                (ix, nx, lx), (iy, ny, ly) = ((f.field("rep").to_numpy(), f.field("many").to_numpy(), np.array(f.field("label").to_pylist(), object)) for f in (x, y))
                count_x, count_y, edges = np.zeros(len(ix), np.int64), np.zeros(len(iy), np.int64), []
                for label in sorted(set(lx) & set(ly)):
                    i, j = np.flatnonzero(lx == label), np.flatnonzero(ly == label)
                    links = unit(matrix(x.field("v").take(pa.array(i)))) @ unit(matrix(y.field("v").take(pa.array(j)))).T >= threshold
                    if same:
                        links &= ix[i][:, None] != iy[j][None, :]
                    count_x[i] += links @ ny[j]
                    if not same:
                        count_y[j] += nx[i] @ links
                    edges += _forest(links, ix[i], iy[j])
                ids, n = np.concatenate([ix, iy]), np.concatenate([count_x, count_y])
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[on], np.array([e[0] for e in edges], np.int64)])), pa.array([*[None] * len(on), *[e[1] for e in edges]], pa.int64()), pa.array(np.concatenate([n[on], np.zeros(len(edges), np.int64)]))], names=["a", "b", "n"])

    spread = max(1, total // leaf)
    wide = pairs.repartition(spread, "p", "q").join(leaves.select(F.col("leaf").alias("p"), F.col("rows").alias("x")), "p").join(leaves.select(F.col("leaf").alias("q"), F.col("rows").alias("y")), "q").select("p", "q", "x", "y")
    found = materialize(wide.mapInArrow(compare, "a long, b long, n long"), "found")
    comp = materialize(components(found.where("b is not null").select("a", "b")), "components")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    of = materialize(classes.select("key", "rep", "many").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "of")
    out = keyed.select("id", "key").join(of, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))

