"""Shared helpers: scratch tables in the cluster's folder, Arrow batches cut by bytes, word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.session import ship_package

#: Bytes of text that a task works on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Files of a scratch table whose size is known: so many at least, and one for so many rows.
LEAST_FILES, FILE_ROWS = 8, 50_000

# ------------------------------------------------------------------ scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or one set on the context.

    A session on a ``local`` master without either gets a temporary folder; any other
    session must name one, because a machine-local folder isn't seen by its executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="litsift-shared-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; each is read back from there."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write a table and read it back. Of one with about so many rows, few files are made."""
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, rows // FILE_ROWS))
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, table: DataFrame, key: str | list[str], weight: str, hot: int) -> DataFrame:
    """The rows of ``left`` whose key is in a table, with the table's other columns.

    ``weight`` is how often the key occurs in ``left``. Heavy keys, those with at least one in ``hot`` of
    all, are at most ``hot`` and are broadcast; the others are shuffled, and none has many rows.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * hot >= total
    values = [c for c in table.columns if c != weight]
    first = table.filter(heavy).select(*values, F.lit(True).alias("is_hot"))
    met = left.join(F.broadcast(first), key, "left")
    rest = met.filter(F.col("is_hot").isNull()).select(left.columns).join(table.filter(~heavy).select(values), key)
    return met.filter("is_hot").drop("is_hot").unionByName(rest)


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


# ------------------------------------------------------------------ Arrow batches


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of ``column`` or one row."""
    offsets = raw(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets; a null is empty."""
    if texts.null_count:
        empty = b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else ""
        texts = texts.fill_null(empty)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if offs is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


# ------------------------------------------------------------------ words and hashes

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2^64
#: Powers kept between calls, and the bytes of words hashed at once; longer rows of powers are made anew.
_KEPT = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = min(1 << max(12, int(n - 1).bit_length()), max(n, _KEPT + 1))
        inverse = pow(int(base), -1, 1 << 64)
        out = []
        for b in (int(base), inverse):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        have = out[0], out[1]
        if size <= _KEPT + 1:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser over an array, after adding a seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               base: np.uint64 = _BASE) -> np.ndarray:
    """A polynomial hash of values[start:end], mixed with the length, for each range."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    poly = (total[ends] - total[starts]) * down[starts]
    return mix(poly + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def find_words(flat: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES):
    """Byte starts and ends of the words of each row, and each row's first word number.

    ``gaps`` marks the byte values between words. UTF-8 continuation bytes are never gaps.
    """
    inside = ~gaps[flat]
    before = np.zeros(len(flat) + 1, bool)
    before[1:] = inside
    edge = offsets[offsets < len(flat)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(flat) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words are in order and taken a stretch of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _KEPT, "right")))
        first = starts[a]
        part = flat[first:ends[b - 1]].astype(np.uint64) + np.uint64(1)
        out[a:b] = range_hash(part, starts[a:b] - first, ends[a:b] - first, base)
        a = b
    return out


# ------------------------------------------------------------------ memory of Python workers


def give_back() -> None:
    """Return what a task has freed to the system: a worker that goes on keeps its heap otherwise."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` whose worker holds nothing of it afterwards."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held
