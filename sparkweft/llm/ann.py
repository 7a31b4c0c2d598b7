"""Approximate nearest neighbours by cross-polytope hashing (operator 8).

A vector, scaled to unit length and padded to a power of two, goes through
``TABLES`` pseudo-rotations (three rounds of random signs and a fast Hadamard
transform); each table files it under the signed axis nearest to it, apart by
bands of its length. Rows and queries meet by a join on (table, band, axis);
a bucket of more than ``ROWS`` rows is split by a salt, which its queries
visit all. In a bucket, the exact Euclidean distances rank the rows.

A query probes the axes of its greatest coordinates. How many follows from
what it seeks: a first round on one table gives a distance within which its
``k`` neighbours lie; a row of a given length that is nearer must have at
least a certain cosine, and so many axes are probed that a row of that cosine
is met with a chance of ``SEEK``. Bands that can hold nothing nearer are left
out; where the probes of all tables would read more than a band, one table's
buckets read all of it, which is exact. So short and long vectors, and queries
whose neighbours are weak, are served by more probes, never by a cap.

Equal vectors are one: of each, the ``k + 1`` smallest ids stand for all as
candidates, and equal queries are answered once. Results do not depend on the
number of tasks.

Vectors that are null, zero, or hold null or non-finite components take no
part; vectors of another length than the query's are no candidates. A query
with no other row has no result. Ties go to the smaller id. Rows without an
id are left out; rows that repeat an id count as one for each distinct
vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import lean, rows_of, stored

TABLES, ROUNDS = 8, 3
#: Axes that the first round probes, in one table.
FIRST = 8
#: Chance to meet a row of the least cosine that matters.
SEEK = 0.95
#: Rows of a bucket's part, queries compared with it at once, and ratio of the lengths in a band.
ROWS, QUERIES, RATIO = 16_384, 1024, 1.2
#: Pairs of queries and rows compared at once.
CELLS = 1 << 20
#: Buckets whose sizes may be broadcast: some 40 bytes each.
FEW_BUCKETS = 200_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Rotations:
    def __init__(self, dims: int, tables: int = TABLES, seed: int = 7):
        self.width = 1 << max(1, (dims - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, ROUNDS, self.width))

    def coordinates(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Rotated coordinates followed by their negatives: one column for each signed axis."""
        x = np.zeros((len(unit), self.width), np.float32)
        x[:, : unit.shape[1]] = unit
        for signs in self.signs[table]:
            x = hadamard(x * signs)
        return np.concatenate((x, -x), axis=1)


@lru_cache(maxsize=8)
def rotations(dims: int, tables: int) -> Rotations:
    return Rotations(dims, tables)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, logarithms of the lengths); scaled by the largest component first, so that lengths neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / size, (np.log(top) + np.log(size))[:, 0]


def bands(logs: np.ndarray) -> np.ndarray:
    return np.floor(logs / np.log(RATIO)).astype(np.int64)


def least_cosine(band: np.ndarray, log: float, bound: float) -> np.ndarray:
    """Least cosine to a query that a row of each band has if it is nearer than ``bound``; above 1 where none can be."""
    with np.errstate(all="ignore"):
        b = np.exp(np.log(bound) - log)
        lo, hi = (np.exp((band + e) * np.log(RATIO) - log) for e in (-1e-9, 1 + 1e-9))
        # (1 - b^2) / 2t + t / 2 over lengths t of the band, relative to the query's: least at the root of 1 - b^2, or at an end.
        t = np.clip(np.sqrt(np.maximum(1 - b * b, 0.0)), lo, hi)
        c = (1 - b * b) / (2 * t) + t / 2 - 1e-9
    return np.where(np.isnan(c), -1.0, c)


_GRID = np.linspace(0, 1, 41)


@lru_cache(maxsize=64)
def probes_for(dims: int, tables: int, seek: float) -> np.ndarray:
    """Axes to probe in each table so that a row of each cosine of the grid is met with a chance of ``seek``; measured on random pairs."""
    turn = rotations(dims, tables)
    full = 2 * turn.width
    if dims < 8:
        return np.full(len(_GRID), full)
    r = np.random.default_rng(11)
    n = max(200, min(2000, (1 << 20) // dims))
    q, _ = unit_rows(r.normal(size=(n, dims)))
    w = r.normal(size=(n, dims))
    w, _ = unit_rows(w - (w * q).sum(axis=1, keepdims=True) * q)
    axes = turn.coordinates(q, 0)
    out = []
    for c in _GRID:
        own = turn.coordinates(c * q + np.sqrt(1 - c * c) * w, 0).argmax(axis=1)
        place = np.sort((axes > axes[np.arange(n), own][:, None]).sum(axis=1))
        # The share of pairs met in one table that gives the chance in all.
        need = 1 - (1 - seek) ** (1 / tables)
        out.append(int(place[min(n - 1, int(np.ceil(need * n)))]) + 1)
    return np.minimum.accumulate(np.array(out))


def probes(cosines: np.ndarray, dims: int, tables: int, seek: float) -> np.ndarray:
    """Axes to probe in each table; all of them, in one table, where that reads less."""
    full = 2 * rotations(dims, tables).width
    p = probes_for(dims, tables, seek)[np.clip(np.searchsorted(_GRID, cosines, side="right") - 1, 0, len(_GRID) - 1)]
    p = np.where((cosines < 0) | (p * tables >= full), full, p)
    return np.where(cosines > 1, 0, p)


def nearest(x: np.ndarray, low: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, places, distances): for each query, the rows of ``x`` within its bound that may be among the k + 1 nearest by distance, then ``low``; all of those, and hardly more."""
    ux, lx = unit_rows(x)
    uq, lq = unit_rows(q)
    step = max(1, CELLS // len(x))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        with np.errstate(all="ignore"):
            t = np.exp(lx[None, :] - lq[part, None])
            # Squares of distances over the query's own length, but for some rounding; the near ones are measured exactly.
            slack = 1e-12 * (1 + t * t)
            near = 1 + t * t - 2 * t * (uq[part] @ ux.T)
            limit = np.exp(2 * (np.log(bound[part]) - lq[part])) * (1 + 1e-12)
            least = near - slack
            fit = ~(least > limit[:, None])
            if len(x) > k + 1:
                upper = np.where(fit, near + slack, np.inf)
                fit &= ~(least > np.partition(upper, k, axis=1)[:, k][:, None])
            i, j = np.nonzero(fit)
            d = np.sqrt(((x[j] - q[part][i]) ** 2).sum(axis=1))
        # Beyond ties, few are more than needed; where many tie, the first by ``low`` stay.
        crowd = np.flatnonzero(np.bincount(i, minlength=len(fit)) > 4 * (k + 1))
        if len(crowd):
            kept = ~np.isin(i, crowd)
            for c in crowd.tolist():
                mine = np.flatnonzero(i == c)
                kept[mine[np.lexsort((low[j[mine]], d[mine]))[: k + 1]]] = True
            i, j, d = i[kept], j[kept], d[kept]
        yield i + at, j, d


_CODED = "rid long, dims int, band long, axes array<int>, v binary, low long"
_PROBES = pa.schema([("dims", pa.int32()), ("tab", pa.int32()), ("band", pa.int64()), ("axis", pa.int32()), ("rid", pa.int64()), ("v", pa.binary()), ("bound", pa.float64())])
_FOUND = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("low", pa.int64()), ("score", pa.float64())])
_KEYS = ["dims", "tab", "band", "axis", "salt"]


def _by_dims(blobs: list[bytes], dims: list[int], kind: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """Vectors of a batch, those of one length at a time."""
    for d in sorted(set(dims)):
        at = [i for i, x in enumerate(dims) if x == d]
        yield at, np.frombuffer(b"".join(blobs[i] for i in at), kind).reshape(len(at), d).astype(np.float64)


def _code(tables: int, kind: str):
    """Vectors with the axis that every table files them under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows_of(batch, "v").to_pylist()
            blobs, dims = [np.array(v, kind).tobytes() for v in found], [len(v) for v in found]
            axes, band = [None] * len(found), np.zeros(len(found), np.int64)
            for at, x in _by_dims(blobs, dims, kind):
                unit, logs = unit_rows(x)
                turn = rotations(x.shape[1], tables)
                own = np.stack([turn.coordinates(unit, t).argmax(axis=1) for t in range(tables)], axis=1)
                band[at] = bands(logs)
                for i, a in zip(at, own.tolist()):
                    axes[i] = a
            yield pa.RecordBatch.from_arrays([rows_of(batch, "rid"), pa.array(dims, pa.int32()), pa.array(band), pa.array(axes, pa.list_(pa.int32())), pa.array(blobs, pa.binary()), rows_of(batch, "low")], names=["rid", "dims", "band", "axes", "v", "low"])

    return run


def _probe(tables: int, kind: str, seek: float, first: bool):
    """The buckets that each query visits, in every band that may hold a nearer row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs, dims = (rows_of(batch, c).to_pylist() for c in ("rid", "v", "dims"))
            there, bound = rows_of(batch, "bands").to_pylist(), rows_of(batch, "bound").to_pylist()
            for at, x in _by_dims(blobs, dims, kind):
                unit, logs = unit_rows(x)
                turn = rotations(x.shape[1], tables)
                order = [np.argsort(-turn.coordinates(unit, t), axis=1, kind="stable") for t in range(1 if first else tables)]
                for j, i in enumerate(at):
                    # A band is visited if it may hold what the query seeks, nearest bands first.
                    band = np.array(sorted(there[i]), np.int64)
                    limit = np.inf if bound[i] is None else bound[i]
                    many = np.full(len(band), min(FIRST, 2 * turn.width)) if first else probes(least_cosine(band, logs[j], limit), x.shape[1], tables, seek)
                    tab, bnd, axis = [], [], []
                    for b, p in zip(band.tolist(), many.tolist()):
                        for t in range(1 if p == 2 * turn.width else len(order)):
                            axis.append(order[t][j, :p])
                            tab.append(np.full(p, t))
                            bnd.append(np.full(p, b))
                    if axis and (n := sum(map(len, axis))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims[i]), pa.int32()), pa.array(np.concatenate(tab), pa.int32()), pa.array(np.concatenate(bnd), pa.int64()), pa.array(np.concatenate(axis), pa.int32()), pa.array(np.full(n, ids[i]), pa.int64()), pa.array([blobs[i]] * n, pa.binary()), pa.array(np.full(n, limit))], schema=_PROBES)

    return run


def _match(k: int, kind: str):
    """Buckets sorted by key, rows before queries: what may be among the k + 1 nearest rows of every query in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list, asked: list) -> Iterator[pa.RecordBatch]:
            if not rows or not asked:
                return
            x, q = (np.frombuffer(b"".join(r[1] for r in part), kind).reshape(len(part), -1).astype(np.float64) for part in (rows, asked))
            rid, low = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            names = np.array([r[0] for r in asked], np.int64)
            for i, j, d in nearest(x, low, q, np.array([r[3] for r in asked]), k):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(rid[j]), pa.array(low[j]), pa.array(d)], schema=_FOUND)

        now, rows, asked = None, [], []
        for batch in batches:
            for key, row in zip(zip(*(rows_of(batch, c).to_pylist() for c in _KEYS)), zip(*(rows_of(batch, c).to_pylist() for c in ("rid", "v", "low", "bound")))):
                if key != now or len(asked) == QUERIES:
                    yield from answer(rows, asked)
                    asked = []
                    if key != now:
                        now, rows = key, []
                (rows if row[3] is None else asked).append(row)
        yield from answer(rows, asked)

    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, tables: int = TABLES, seek: float = SEEK, rows_each: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if single else ("<f8", "double")
    # Adding zero turns -0 into 0, so that equal vectors have equal hashes.
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast(number) + F.lit(0).cast(number)).alias("v"))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = stored(v.where(F.col("vec_id").isNotNull() & F.forall("v", fit) & F.exists("v", lambda x: x != 0)).distinct(), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = v.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    rows = stored(rows.select(F.xxhash64("v").alias("rid"), "v", "ids"), "distinct")
    coded = stored(rows.select("rid", "v", F.col("ids")[0].alias("low")).mapInArrow(lean(_code(tables, kind)), _CODED), "coded")
    asked = stored(v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("rid")), "asked")

    filed = lambda f: f.select("dims", "band", F.posexplode("axes").alias("tab", "axis"), "rid", "v", "low")
    sizes = filed(coded).groupBy("dims", "tab", "band", "axis").agg(F.ceil(F.count(F.lit(1)) / rows_each).cast("int").alias("salts"))
    sizes = stored(sizes, "sizes")
    if sizes.count() <= FEW_BUCKETS:
        sizes = F.broadcast(sizes)
    there = coded.groupBy("dims").agg(F.collect_set("band").alias("bands"))
    queries = stored(coded.select("rid", "dims", "v").join(asked.select("rid").distinct(), "rid").join(there, "dims"), "queries")
    where = ["dims", "tab", "band", "axis"]

    def meet(asks: DataFrame, first: bool) -> DataFrame:
        """(qid, rid, low, score): what the queries find in the buckets they probe."""
        base = filed(coded.withColumn("axes", F.slice("axes", 1, 1)) if first else coded).join(sizes, where)
        base = base.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("salts")).cast("int")).withColumn("bound", F.lit(None).cast("double"))
        visits = asks.mapInArrow(lean(_probe(tables, kind, seek, first)), "dims int, tab int, band long, axis int, rid long, v binary, bound double").join(sizes, where)
        visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("low", F.lit(None).cast("long"))
        cols = [*_KEYS, "rid", "v", "low", "bound"]
        both = base.select(cols).unionByName(visits.select(cols)).repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.col("bound").isNotNull())
        return both.mapInArrow(lean(_match(k, kind)), "qid long, rid long, low long, score double").distinct()

    def best(found: DataFrame, many: int) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("score", "low"))).where(F.col("nth") <= many)

    # Within the distance of the k-th other vector that the first round finds lie the k nearest.
    early = best(meet(queries.withColumn("bound", F.lit(None).cast("double")), True).where("rid != qid"), k).groupBy(F.col("qid").alias("rid")).agg(F.max("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    bounded = stored(queries.join(early.where(F.col("n") == k).select("rid", "bound"), "rid", "left"), "bounded")
    found = best(meet(bounded, False), k + 1)
    lists = found.select("qid", "rid", "score").join(rows.select("rid", "ids"), "rid").select("qid", "score", F.explode("ids").alias("vec_id"))
    lists = lists.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    out = asked.join(lists, F.col("rid") == F.col("qid")).select("query_id", F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
