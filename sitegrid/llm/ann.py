"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees the pivots, nearest first, and posted in the inverted files of its
first few pivots. A query visits the files of its own nearest pivots, more of them. There, postings are ranked by the
footrule distance between the whole permutations, before any product is computed; the best are reranked by the exact inner
product. A vector that stands in several visited files is ranked in the one nearest to the query only.

How many are reranked: the best by footrule overall, max(least, factor * sqrt(rows)) of them in expectation. A query's bound
on the footrule is the matching quantile of its distances to a bounded sample, so that files need not wait for each other.
Whatever is within ``near`` of the query, as copies are, is always compared, however many there are.

Files are cut in parts, and all queries stream past a part, so neither side of a file has to fit in memory. Equal vectors are
posted once, with as many of their smallest ids as a result can hold; equal queries ask once. For the largest inner product,
vectors are completed to equal lengths before pivots are ordered, so that near means large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegrid.llm.common import Tables, materialize
from sitegrid.llm.ego import matrix, usable

#: Postings of a part, at most.
PART = 32_768


def _completed(m: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by the longest row's length, with one more component that makes every row as long as that."""
    m = m / longest
    return np.column_stack([m, np.sqrt(np.maximum(0, 1 - (m * m).sum(1)))])


def ranks(m: np.ndarray, pivots: np.ndarray, longest: float) -> np.ndarray:
    """For each row, every pivot's place in its permutation."""
    order = np.argsort(-(_completed(m, longest) @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return out


def apart(some: np.ndarray, n: int, most: float = 0.8) -> np.ndarray:
    """Up to n of the vectors, in order, none with a cosine above most to an earlier one: many like pivots would weigh as many."""
    unit = some / np.sqrt((some * some).sum(axis=1, keepdims=True))
    out: list[int] = []
    for i in range(len(unit)):
        if len(out) == n:
            break
        if not out or (unit[out] @ unit[i]).max() <= most:
            out.append(i)
    return some[out]


class Part:
    """The postings of a part of one pivot's file. search() gives the best of one query, and how many were compared."""

    def __init__(self, pivot: int, rep: np.ndarray, vectors: np.ndarray, places: np.ndarray, post: int, k: int) -> None:
        self.pivot, self.rep, self.vectors, self.places, self.k = pivot, rep, vectors, places, k
        self.on = np.ascontiguousarray((places < post).T)

    def search(self, vector: np.ndarray, place: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
        earlier = np.flatnonzero(place < place[self.pivot])
        mine = np.flatnonzero(~self.on[earlier].any(axis=0)) if len(earlier) else np.arange(len(self.rep))
        foot = np.abs(self.places[mine] - place).sum(axis=1, dtype=np.int32)
        mine = mine[foot <= bound]
        score = (self.vectors[mine] * vector).sum(axis=1)
        if len(mine) > self.k:
            top = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            mine, score = mine[top], score[top]
        order = np.lexsort((self.rep[mine], -score))[: self.k]
        return self.rep[mine][order], score[order], len(foot)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, post: int = 8, visit: int = 32, least: int = 512, factor: float = 5.0, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) with up to k rows for each row of queries: vectors with the largest inner product.

    Candidates are all rows of vectors but the query's own id; ties go to the smaller id. score is the inner product in double
    precision. Vectors that are null, all zero, or hold null or non-finite components take no part, as candidates or as
    queries; nor do candidates of another length than the query. Pivots, and the sample that bounds footrules, are at most
    ``pivots`` and ``sample`` vectors of the commonest length among them, pivots no two alike; every vector is indexed. Vectors of another length
    stand in one file of their length, in parts, and are compared whole. Ids are longs; repeated rows are one vector, and
    rows without an id take no part. Other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("key", F.sha2(F.to_json("v"), 256))
    with Tables(spark) as written:
        keyed = written(v, "keyed")
        # the k + 1 smallest ids of each class of equal vectors, salted so that no class meets in one task
        salted = keyed.select("key", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        few = lambda df, *by: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
        ids = few(few(salted, "key", "salt").drop("salt"), "key").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        classes = written(keyed.groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("rep")).join(ids, "key").select("rep", "key", "v", "ids"), "classes")
        total, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
        longest = longest or 1.0
        some = [r.v for r in classes.select("v").orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(sample).toLocalIterator()]
        size = max({len(x) for x in some}, key=lambda n: sum(len(x) == n for x in some)) if some else 1
        some = np.array([x for x in some if len(x) == size]).reshape(-1, size)
        chosen = apart(some, pivots)
        m = max(1, len(chosen))
        n_post, n_visit = (post, visit) if m > 2 * visit else (m, m)
        share = min(1.0, max(least, factor * total**0.5) / max(1, total))
        near = m * m // 16
        shared = spark.sparkContext.broadcast((_completed(chosen, longest) if len(chosen) else np.zeros((1, size + 1)), some))

        def place(files: int, bounded: bool):
            """(rep, v) -> (rep, v, near, bound): the files of each vector, and for queries the bound on the footrule."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                p, drawn = shared.value
                drawn = ranks(drawn, p, longest) if bounded and len(drawn) else None
                for b in batches:
                    column = b.column(1)
                    sizes = np.array(column.value_lengths().to_pylist())
                    out, bound = [[-int(n)] for n in sizes], np.full(len(sizes), np.iinfo(np.int32).max, np.int64)
                    at = np.flatnonzero(sizes == size)
                    if len(at):
                        places = ranks(matrix(column.take(pa.array(at))), p, longest)
                        first = np.argsort(places, axis=1, kind="stable")[:, :files]
                        for i, row, own in zip(at, first, places, strict=True):
                            out[i] = row.tolist()
                            if bounded and share < 1:
                                foot = np.abs(drawn - own).sum(axis=1, dtype=np.int32)
                                cut = min(len(foot) - 1, max(8, int(np.ceil(share * len(foot)))))
                                bound[i] = max(near, int(np.partition(foot, cut)[cut]))
                    yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(out, pa.list_(pa.int32())), pa.array(bound)], names=["rep", "v", "near", "bound"])

            return run

        kind = "rep long, v array<double>, near array<int>, bound long"
        posts = written(classes.select("rep", "v").mapInArrow(place(n_post, False), kind), "posts")
        asked = keyed.select("id", "key").join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").distinct()
        asked = written(asked.join(classes.select("key", "rep"), "key").select("id", "rep"), "asked")
        asks = written(classes.select("rep", "v").join(asked.select("rep").distinct(), "rep", "left_semi").mapInArrow(place(n_visit, True), kind), "asks")
        # parts of about equal size, half as large as a file of average size or smaller
        even = max(1, min(PART, -(-total * n_post // (2 * m))))
        files = posts.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / even).cast("int").alias("parts"))
        files = F.broadcast(written(files, "files"))  # one row a pivot or a length of vectors
        posted = posts.select(F.explode("near").alias("pivot"), "rep", "v", "bound").join(files, "pivot").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("ask", F.lit(0))
        visits = asks.select(F.explode("near").alias("pivot"), "rep", "v", "bound").join(files, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ask", F.lit(1))
        columns = ["pivot", "part", "ask", "rep", "v", "bound"]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value[0]
            now, held, part = None, [], None
            for b in batches:
                keys = np.column_stack([b.column(c).to_numpy() for c in range(3)])
                edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
                for i, j in zip(edges, edges[1:], strict=False):
                    pivot, number, ask = keys[i].tolist()
                    if (pivot, number) != now:
                        now, held, part = (pivot, number), [], None
                    rep, m_v = b.column(3).slice(i, j - i).to_numpy(), matrix(b.column(4).slice(i, j - i))
                    if not ask:
                        held.append((rep, m_v))
                        continue
                    if not held:
                        continue
                    if part is None:
                        reps, vs = (np.concatenate(x) for x in zip(*held, strict=True))
                        part = Part(pivot if pivot >= 0 else 0, reps, vs, ranks(vs, p, longest) if pivot >= 0 else np.zeros((len(vs), 1), np.int16), n_post, k + 1)
                    places = ranks(m_v, p, longest) if pivot >= 0 else np.zeros((len(m_v), 1), np.int16)
                    found = [part.search(x, y, int(z)) for x, y, z in zip(m_v, places, b.column(5).slice(i, j - i).to_numpy(), strict=True)]
                    off = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
                    others, scores = (np.concatenate([f[c] for f in found]) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.ListArray.from_arrays(off, pa.array(others)), pa.ListArray.from_arrays(off, pa.array(scores)), pa.array([f[2] for f in found], pa.int64())], names=["rep", "other", "score", "ranked"])

        groups = max(1, -(-total * n_post // even))
        both = posted.select(*columns).unionByName(visits.select(*columns)).repartitionByRange(min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), "pivot", "part").sortWithinPartitions("pivot", "part", "ask")
        found = both.mapInArrow(search, "rep long, other array<long>, score array<double>, ranked long")
        close = found.select("rep", F.explode(F.arrays_zip("other", "score")).alias("x")).select("rep", "x.other", "x.score")
        first = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
        best = written(close.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("rep", "other", "score"), "best")
        close = best.join(classes.select(F.col("rep").alias("other"), "ids"), "other").select("rep", F.explode("ids").alias("vec_id"), "score")
        ranked = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        answers = written(close.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "answers")
        mine = asked.join(answers, "rep").select("id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("id")), 1, k).alias("found"))
        out = mine.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
        return materialize(out, "nearest")
