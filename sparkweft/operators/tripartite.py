"""Clustering of a graph whose nodes have three kinds and whose triangles take one node of each.

``rows(a, b, c)`` name the edges ab, ac and bc, each as often as it likes. Rows
are dealt once by their ``a`` into shares, stored in order of ``b``; pairs of
``b`` and ``c`` are dealt once by ``b`` into blocks. A task owns a share: it
holds the share's edges ac, walks along its edges ab and reads the block of the
``b`` it is at. What lies at the third side of an edge ab is looked up in the
task, from the shorter of its ends' lists, so neither lists nor triangles are
moved; only counts leave it. What is written grows with the rows alone, for
blocks are read again by every share, not copied.

A task holds distinct edges of a share and of a block, a bounded slice of the
walk and of what is looked up. There are as many shares as keep these bounded.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.sources.store import scratch, spent, stored

#: Rows of a share or a block, about; rows that are worth a share where cores are free.
SHARE, LEAST = 3_000_000, 100_000
#: Rows read at once, and thirds looked up at once.
SLICE, PAIRS = 1_000_000, 2_000_000
#: The list of ``b`` may be so many times as long as that of ``a`` before the other one is walked along.
LONGER = 4

_COUNTS = "kind int, key long, degree long, triangles long"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shares_for(rows: int, cores: int) -> int:
    return max(1, math.ceil(rows / SHARE), min(cores, math.ceil(rows / LEAST)))


def _read(path: str, names: list[str]) -> Iterator[pa.Table]:
    """The rows of a folder's files in their order, a slice at a time; of a folder that was never written, none."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + os.path.normpath(path[len("file:") :]).lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(path)
    for info in sorted(store.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(SLICE, columns=names):
                    yield pa.Table.from_batches([batch])


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _block(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a block, by b, then c."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for t in _read(path, ["b", "c"]):
        b, c = _numbers(t, "b"), _numbers(t, "c")
        new = _changes(b, c)
        last = found[-1]
        if len(last[0]) and (last[0][-1], last[1][-1]) == (b[0], c[0]):
            new[0] = False
        if new.any():
            found.append((b[new], c[new]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spans(first: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, place) for the ``many[i]`` places from ``first[i]`` on, a bounded number at a time."""
    total = np.cumsum(many)
    whole = int(total[-1]) if len(total) else 0
    for lo in range(0, whole, PAIRS):
        at = np.arange(lo, min(lo + PAIRS, whole))
        i = np.searchsorted(total, at, side="right")
        yield i, first[i] + at - (total[i] - many[i])


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


class _Share:
    """The edges ac of a share: ``a`` and ``c`` by their places in ``as_`` and ``cs``, as sorted keys."""

    def __init__(self, path: str):
        kept, waiting, held = pa.table({"a": pa.array([], pa.int64()), "c": pa.array([], pa.int64())}), [], 0
        for t in _read(path, ["a", "c"]):
            waiting.append(t.select(["a", "c"]).cast(kept.schema))
            held += len(t)
            if held > max(SLICE, len(kept)):
                kept, waiting, held = self._distinct([kept, *waiting]), [], 0
        kept = self._distinct([kept, *waiting])
        self.as_ = np.unique(kept["a"].drop_null().to_numpy())
        kept = kept.drop_null()
        self.cs = np.unique(_numbers(kept, "c"))
        a, c = np.searchsorted(self.as_, _numbers(kept, "a")), np.searchsorted(self.cs, _numbers(kept, "c"))
        self.keys = np.sort(a * len(self.cs) + c)
        a = self.keys // max(1, len(self.cs))
        self.third = self.keys - a * len(self.cs)
        self.many = np.bincount(a, minlength=len(self.as_))
        self.first = np.cumsum(self.many) - self.many
        # Most of what is looked up is not there, which a byte tells.
        bits = max(10, math.ceil(math.log2(8 * len(self.keys) + 1)))
        self.shift = np.uint64(64 - bits)
        self.told = np.zeros(1 << bits, bool)
        self.told[(self.mixed(self.as_[a], 0) + self.mixed(self.cs[self.third], 1)) >> self.shift] = True

    @staticmethod
    def _distinct(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["a", "c"], use_threads=False).aggregate([])

    @staticmethod
    def mixed(v: np.ndarray, which: int) -> np.ndarray:
        return v.astype(np.uint64) * _MIX[which]

    def closed(self, a: np.ndarray, b: np.ndarray, block: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(edge, c) of every triangle of the edges (places in ``as_``, values of b), c by its place in ``cs``."""
        bs, cs = block
        first = np.searchsorted(bs, b)
        many = np.searchsorted(bs, b, side="right") - first
        short = many <= LONGER * self.many[a]
        e = np.flatnonzero(short)
        of_a, of_c = self.mixed(self.as_[a[e]], 0), self.mixed(cs, 1)
        for i, place in _spans(first[e], many[e]):
            near = np.flatnonzero(self.told[(of_a[i] + of_c[place]) >> self.shift])
            i, place = e[i[near]], place[near]
            c, known = _among(self.cs, cs[place])
            hit = known & _among(self.keys, a[i] * len(self.cs) + c)[1]
            yield i[hit], c[hit]
        e = np.flatnonzero(~short & (self.many[a] > 0))
        if len(e):
            c, known = _among(self.cs, cs)
            named = np.cumsum(_changes(bs)) - 1
            keys = (named * len(self.cs) + c)[known]
            at = named[first[e]]
            for i, place in _spans(self.first[a[e]], self.many[a[e]]):
                c = self.third[place]
                hit = _among(keys, at[i] * len(self.cs) + c)[1]
                yield e[i[hit]], c[hit]


def _counts(kind: int, key: np.ndarray, degree: np.ndarray, triangles: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(degree.astype(np.int64)), pa.array(triangles.astype(np.int64))], names=["kind", "key", "degree", "triangles"])


def _walk(path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, a, b) of a share's distinct edges ab, which lie in order of block and b, a slice at a time."""
    last = None
    for t in _read(path, ["y", "b", "a"]):
        t = t.drop_null()
        if not len(t):
            continue
        y, b, a = (_numbers(t, n) for n in ("y", "b", "a"))
        new = _changes(b, a)
        new[0] = last != (b[0], a[0])
        last = (b[-1], a[-1])
        y, b, a = y[new], b[new], a[new]
        starts = np.flatnonzero(_changes(y))
        for lo, hi in zip(starts, [*starts[1:], len(y)]):
            yield int(y[lo]), a[lo:hi], b[lo:hi]


def _share_counts(rows: str, blocks: str) -> Callable:
    """Counts of a share's nodes: whole for its ``a``, the share's part for ``b`` and ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for batch in batches for x in batch.column(0).to_pylist()):
            share = _Share(f"{rows}/x={x}")
            of_a, of_c = np.zeros((2, len(share.as_)), np.int64), np.zeros(len(share.cs), np.int64)
            of_a[0] = share.many
            held, block = None, None
            for y, a, b in _walk(f"{rows}/x={x}"):
                if y != held:
                    held, block = y, _block(f"{blocks}/y={y}")
                a = np.searchsorted(share.as_, a)
                new = _changes(b)
                named = np.cumsum(new) - 1
                of_b = np.zeros(int(new.sum()), np.int64)
                for i, c in share.closed(a, b, block):
                    of_a[1] += np.bincount(a[i], minlength=len(share.as_))
                    of_b += np.bincount(named[i], minlength=len(of_b))
                    of_c += np.bincount(c, minlength=len(of_c))
                of_a[0] += np.bincount(a, minlength=len(share.as_))
                yield _counts(1, b[new], np.bincount(named), of_b)
            yield _counts(0, share.as_, *of_a)
            yield _counts(2, share.cs, np.bincount(share.third, minlength=len(of_c)), of_c)

    return run


def _block_counts(blocks: str) -> Callable:
    """How many edges bc the nodes of a block have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y in (y for batch in batches for y in batch.column(0).to_pylist()):
            for kind, ends in zip((1, 2), _block(f"{blocks}/y={y}")):
                key, many = np.unique(ends, return_counts=True)
                yield _counts(kind, key, many, np.zeros(len(key)))

    return run


def _dealt(df: DataFrame, name: str, part: Column, parts: int, *order: str, **made: Column) -> str:
    """The folder into which rows were written by their ``part``, one file each, in order; columns are ``made`` after rows have moved."""
    path = scratch(df.sparkSession, "dealt")
    moved = df.repartitionById(parts, part).withColumns({name: part, **made})
    moved.sortWithinPartitions(name, *order).write.partitionBy(name).parquet(path)
    return path


def _of_nulls(rows: DataFrame) -> DataFrame:
    """Degrees by edges of which an end is null; all null nodes are one."""
    odd = rows.where("a IS NULL OR b IS NULL OR c IS NULL")
    ends = [F.struct(F.lit(k).alias("k"), F.col(u).alias("u"), F.lit(m).alias("m"), F.col(v).alias("v")) for k, u, m, v in ((0, "a", 1, "b"), (0, "a", 2, "c"), (1, "b", 2, "c"))]
    edges = odd.select(F.inline(F.array(*ends))).where("u IS NULL OR v IS NULL").distinct()
    node = lambda k, u: F.struct(F.when(F.col(u).isNotNull(), F.col(k)).alias("kind"), F.col(u).alias("key"))
    return edges.select(F.inline(F.array(node("k", "u"), node("m", "v")))).select("kind", "key", F.lit(1).cast("long").alias("degree"), F.lit(0).cast("long").alias("triangles"))


def clustering(rows: DataFrame, many: int) -> DataFrame:
    """(kind, key, degree, triangles, coefficient) of the nodes in about ``many`` ``rows(a, b, c)`` of whole numbers; kinds are 0, 1 and 2, that of nulls is null."""
    spark = rows.sparkSession
    parts = shares_for(many, spark.sparkContext.defaultParallelism)
    part = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    longs = rows.select(*(F.col(n).cast("long").alias(n) for n in "abc"))
    shares = _dealt(longs, "x", part("a"), parts, "y", "b", "a", y=part("b"))
    again = spark.read.schema("a long, b long, c long, y int, x int").parquet(shares)
    blocks = _dealt(again.where("b IS NOT NULL AND c IS NOT NULL").select("b", "c"), "y", part("b"), parts, "b", "c")
    each = spark.range(0, parts, 1, parts)
    told = each.mapInArrow(_share_counts(_named(spark, shares), _named(spark, blocks)), _COUNTS).unionByName(each.mapInArrow(_block_counts(_named(spark, blocks)), _COUNTS)).unionByName(_of_nulls(again))
    out = stored(told.groupBy("kind", "key").agg(F.sum("degree").alias("degree"), F.sum("triangles").alias("triangles")), "clustering")
    for path in (shares, blocks):
        again._stored_at = path
        spent(again)
    return out.withColumn("coefficient", _coefficient(F.col("degree"), F.col("triangles")))


def _named(spark, path: str) -> str:
    """A path with its scheme: tasks open it by that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _coefficient(degree: Column, triangles: Column) -> Column:
    pairs = degree * (degree - 1)
    return F.round(F.when(pairs > 0, 2 * triangles / pairs).otherwise(0.0), 6)
