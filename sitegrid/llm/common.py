"""What several operators share: intermediate tables, Arrow batches cut by size, and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Folders that hold results which are still to be read; clean() deletes them.
LEFT: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names. Only a local session may do without: nothing else reads its disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/sitegrid-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to Python, in place of Spark's 64 MB: a batch exists several times over, in the JVM and in Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded to BATCH_BYTES from now on, unless their size was set before."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("64MB", f"{64 << 20}b"):
        conf.set(key, str(BATCH_BYTES))
    return df


def let_go() -> None:
    """Gives memory back to the system: a Python worker outlives its task, and others need the room."""
    gc.unfreeze()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), in small batches; a worker keeps little after its task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        let_go()

    return small_batches(df).mapInArrow(whole, schema)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors. Stays until clean()."""
    folder = scratch(df.sparkSession)
    LEFT.append(folder)
    return _written(df, f"{folder}/{name}")


def clean(spark: SparkSession) -> None:
    """Deletes the results that materialize() wrote; DataFrames over them can't be read after that."""
    while LEFT:
        delete(spark, LEFT.pop())


class Tables:
    """An operator's intermediate tables, in one shared folder that is deleted at the end of the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, scratch(spark), 0

    def __call__(self, df: DataFrame, name: str = "table") -> DataFrame:
        """df written and read again, for use within the block."""
        self.count += 1
        return _written(df, f"{self.folder}/{self.count}-{name}")

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


#: Bits of a Bloom filter, at most: 8 MB.
FILTER_BITS = 1 << 26


def bloom(hashes: DataFrame, n: int) -> tuple[Column, Callable[[Column, Column], Column]]:
    """A filter's bits, and a test of them whether a hash may be one of the n in hashes(h: long): never false for one that is.

    The filter has 16 bits a hash and two of them are set, but its size is bounded; with many more hashes it passes nearly all.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * n - 1).bit_length()))
    spots = lambda h: [F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 29), F.lit(bits))]
    # Spark's bitmaps hold 32768 numbers each, from 1 on
    at = hashes.select(F.explode(F.array(*(x + 1 for x in spots(F.col("h"))))).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    image = bytearray(bits // 8)
    for part, some in parts.collect():
        image[(part - 1) * 4096 : part * 4096] = some
    # as a one-row subquery, so that plans don't spell it out
    held = hashes.sparkSession.createDataFrame([(image,)], "bits binary").scalar()

    def on(held: Column, at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(held, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1

    return held, lambda held, h: on(held, spots(h)[0]) & on(held, spots(h)[1])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with no more than limit bytes of text each, or a single row."""
    for batch in batches:
        column = batch.column(text)
        if len(batch) == 0:
            continue
        off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(off, int(off[start]) + limit, side="right")) - 1)
            yield batch.slice(start, min(stop, len(batch)) - start)
            start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null rows have no bytes."""
    if column.null_count:
        column = pa.array(["" if x is None else x for x in column.to_pylist()], column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for r in (_R, _R_INV):
            p = np.full(size, np.uint64(r))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the row it belongs to; words never cross rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~BLANKS[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    p, q = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[LOWER[data]] * p[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(off, starts, side="right") - 1


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the distinct hashes of its k-word shingles, sorted; with fewer words the whole sequence is one."""
    h, row = words(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    at = np.concatenate([[0], np.cumsum(count)])
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]) if len(s) else s
    out = []
    for i in range(len(off) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            x = np.full(1, np.uint64(b - a))
            for j in range(a, b):
                x = mix(x * np.uint64(0xA0761D6478BD642F) + h[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
