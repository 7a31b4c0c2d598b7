"""Helpers shared by the training-data operators.

Everything that executors and the driver must both see goes below
``shared_dir(spark)``: the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _libc():
    import ctypes

    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # blocks of 4 MB and more go back to the system when freed
        return libc
    except (OSError, AttributeError):  # another C library keeps its own ways
        return None


_LIBC = _libc()


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(f):
    """A worker function that gives its free memory back when its task ends: Python workers live on, beside others."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark resolves it: executors open it by that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share; a private one only where none is set and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkweft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there. Options are those of Parquet."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return held_at(spark.read.schema(df.schema).parquet(path), path)


def held_at(df: DataFrame, path: str) -> DataFrame:
    """A frame that reads a table of ours, so that ``spent`` and ``settled`` find it."""
    df._stored_at = path
    if _on_the_way:
        _on_the_way[-1].append(df)
    return df


#: Tables stored since each ``settled`` that runs began.
_on_the_way: list[list[DataFrame]] = []


def settled(make, name: str) -> DataFrame:
    """Store the frame that ``make`` gives, then delete all tables that were stored on the way to it."""
    _on_the_way.append([])
    try:
        out = stored(make(), name)
    finally:
        made = _on_the_way.pop()
    spent(*(t for t in made if t is not out))
    if _on_the_way:
        _on_the_way[-1].append(out)
    return out


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing to come reads: what was made of them is stored itself."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            drop(df.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of ours below the shared folder, through Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of ``possibly_in``: its table has at most this many bits, 8 MB, whatever the number of keys.
BITS = 1 << 26


def _maybe(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with a column ``_maybe``: false only where the key is surely not among ``keys(key)``. A bitmap of fixed size is broadcast."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bits = keys.select(at(F.col(key)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    place = F.bitmap_bit_position(at(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(at(F.col(key)))).join(F.broadcast(bits), "_bucket", "left")
    return joined.select(*df.columns, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def possibly_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys(key)``, so that a join that follows moves few others."""
    return _maybe(df, key, keys).where("_maybe").select(*df.columns)


def drop_rows(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys(key)``; only rows that may be are moved to find out."""
    keys = stored(keys.select(key), "keys")
    told = _maybe(df, key, keys)
    sure = told.where("not _maybe").select(*df.columns)
    return sure.unionByName(told.where("_maybe").select(*df.columns).join(keys, key, "left_anti"))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Python workers hold a batch of texts in several forms at once, beside the JVM's copy; keep it small, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """One column of a batch, with plain 32-bit-offset strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.string()) if pa.types.is_large_string(col.type) else col


def slices(texts: pa.Array, limit: int = 1 << 19):
    """(first row, string slice) pairs of at most ``limit`` bytes, or of one row."""
    n, at = len(texts), 0
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1]
    while at < n:
        stop = int(np.searchsorted(ends, int(ends[at]) + limit, side="right")) - 1
        stop = min(n, max(at + 1, stop))
        yield at, texts.slice(at, stop - at)
        at = stop


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, _ODD), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0], have[1]


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array whose nulls count as empty."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


#: Word separators of the shingle operators, and the fold of A-Z.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK, fold: np.ndarray | None = LOWER):
    """Word starts, stops, 64-bit hashes and the first word of every text (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~blank[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    lut = _BYTE if fold is None else _BYTE[fold]
    np.cumsum(lut[raw] * up[: len(raw)], out=total[1:])
    return a, b, mix((total[b] - total[a]) * down[a]), np.searchsorted(a, ends)


_K = mix(np.arange(101, 101 + 64, dtype=np.uint64) * _ODD) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (they may run over text ends; cut by position)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _K[0]
    for i in range(1, k):
        out += hashes[i : i + n] * _K[i]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """Hash of one whole short sequence, apart from all k-gram hashes."""
    s = np.uint64(len(hashes) + 7919)
    for i, h in enumerate(hashes):
        s = s * _ODD + h * _K[i % 64]
    return mix(np.array([s], np.uint64))


def shingle_sets(texts: pa.Array, k: int = 5):
    """Sorted distinct shingle hashes of every text: of its k-word runs, or of all its words if fewer."""
    for at, part in slices(texts):
        raw, ends = byte_view(part)
        _, _, h, first = words(raw, ends)
        with np.errstate(over="ignore"):
            g = grams(h, k)
            for i in range(len(part)):
                lo, hi = int(first[i]), int(first[i + 1])
                if hi - lo >= k:
                    yield at + i, np.unique(g[lo : hi - k + 1])
                elif hi > lo:
                    yield at + i, sequence_hash(h[lo:hi])
                else:
                    yield at + i, h[:0]


class IntTable:
    """A hash table from distinct non-negative integers to small ones; whole arrays are looked up at once. Open places, linear probing."""

    EMPTY, ODD = np.int64(-1), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        # Half as wide where all keys fit.
        kind = np.int32 if not len(keys) or keys.max() < 1 << 31 else np.int64
        self.keys, self.values = np.full(1 << bits, self.EMPTY, kind), np.zeros(1 << bits, np.int32)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            # Of those that want one free place, one gets it; the others go on to the next.
            want = np.where(self.keys[at] == self.EMPTY, at, -1)
            places, who = np.unique(want, return_index=True)
            places, who = places[places >= 0], who[places >= 0]
            self.keys[places], self.values[places] = keys[left[who]], values[left[who]]
            rest = np.ones(len(left), bool)
            rest[who] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.ODD) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of keys."""
        at = self.home(keys)
        held = self.keys[at]
        found, out = held == keys, self.values[at]
        on = np.flatnonzero(~found & (held != self.EMPTY))
        at = at[on]
        while len(on):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[on]
            out[on[hit]] = self.values[at[hit]]
            found[on[hit]] = True
            more = ~hit & (held != self.EMPTY)
            on, at = on[more], at[more]
        return out, found


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that a frame reads; None where it is no plain read of one set of files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() != 1 or not leaves.head().getClass().getSimpleName().startswith("LogicalRelation"):
        return None
    return int(leaves.head().stats().sizeInBytes())


def sized(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A frame and its bytes in files. What reads no files (rows in memory, joins) is written first: the planner's guess of it means nothing."""
    found = file_bytes(df)
    if found is None:
        df = stored(df, name)
        found = file_bytes(df)
    return df, found or 0


def null_as_empty(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in names else F.col(c) for c in df.columns))


def open_fs(uri: str):
    """(filesystem, path) for a folder in the shared store, named with its scheme (see ``qualified``)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        path = os.path.normpath(uri[len("file:") :])
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(uri)
