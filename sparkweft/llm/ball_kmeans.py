"""Centroid clustering by ball k-means (operator 13).

Vectors become exact integers, floor(scale * x). The first centroids are the
vectors of the smallest salted hash of their id; each round assigns every
vector to its nearest centroid and moves each centroid that has members to the
floor of their mean.

A cluster is a ball: its centroid and a radius that no member exceeds. After
the centroids have moved, a member's distance to its own centroid is taken
anew. Another centroid can win a member only if it is a neighbour: nearer to
the own centroid than twice the radius. By the halves of the distances to its
neighbours a ball falls into a stable core, whose members are nearer to the
own centroid than half the way to any neighbour and are compared with nothing,
and annuli: a member beyond half the way to the i-th nearest neighbour, but
not to the next, is compared with i neighbours. All of this is decided in
integers (4 d^2 against D^2), so the result is that of comparing everything,
ties to the smaller number included; the radius alone is a float, rounded up.

A round is one pass in which tasks hand back, beside their vectors, sums,
counts and greatest distances for each cluster; these are added up by Spark, so
what the driver sees is one row a cluster and component. Each round's vectors
are written to the shared folder and the round before is deleted. The
centroids go with the tasks: their number is a parameter, not the data's.

Vectors that are null, of another length, or hold a null or non-finite
component are left out. Rows without an id are clustered, but start no
centroid; rows that repeat are clustered each, and may start several. With
fewer vectors than centroids each (with an id) starts one. An empty table, or
one without an id, gives an empty result. A component beyond 2^27 after
scaling is refused, as squares would not fit the 64 bits of a distance. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm.common import lean, rows_of, spent, stored

#: Components beyond this are refused.
MOST = 1 << 27
#: Vectors compared at once.
ROWS = 8192

_STATE = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("members", pa.int64()), ("compared", pa.int64())])
_STATE_SQL = "kind int, vec_id long, vector binary, cluster int, distance long, sums array<long>, members long, compared long"


class Balls:
    """Centroids, and for each its neighbours, nearest first, with the squared distance; those at twice the radius and more are none."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray | None = None):
        self.c = centroids
        self.neighbours: list[list[tuple[int, int]]] = []
        for i, own in enumerate(centroids):
            apart = ((centroids - own) ** 2).sum(axis=1)
            reach = math.inf if radii is None else 4 * radii[i] * radii[i]
            near = [int(j) for j in np.argsort(apart, kind="stable") if j != i and apart[j] <= reach]
            self.neighbours.append([(j, int(apart[j])) for j in near])

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, comparisons) of vectors whose last clusters are known."""
        cluster, distance = before.copy(), np.zeros(len(x), np.int64)
        compared = 0
        order = np.argsort(before, kind="stable")
        cuts = np.searchsorted(before[order], np.arange(len(self.c) + 1))
        for i, near in enumerate(self.neighbours):
            at = order[cuts[i] : cuts[i + 1]]
            if not len(at):
                continue
            members = x[at]
            own = ((members - self.c[i]) ** 2).sum(axis=1)
            best, winner = own.copy(), np.full(len(at), i, np.int32)
            compared += len(at)
            # The ring of a neighbour: members at half the way to it and beyond. Rings shrink outwards.
            ring = np.arange(len(at))
            for j, apart in near:
                ring = ring[4 * own[ring] >= apart]
                if not len(ring):
                    break
                d = ((members[ring] - self.c[j]) ** 2).sum(axis=1)
                compared += len(ring)
                better = (d < best[ring]) | ((d == best[ring]) & (j < winner[ring]))
                best[ring[better]], winner[ring[better]] = d[better], j
            cluster[at], distance[at] = winner, best
        return cluster, distance, compared


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number vectors of the rows that take part."""
    col = batch.column(batch.schema.get_field_index("embedding"))
    lengths = np.diff(col.offsets.to_numpy())
    known = col.is_valid().to_numpy(zero_copy_only=False) & (lengths == dims)
    at = np.flatnonzero(known)
    if not len(at):
        return rows_of(batch, "vec_id").take(pa.array([], pa.int64())), np.zeros((0, dims), np.int64)
    flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    fine = np.isfinite(flat).all(axis=1)  # nulls are nan by now
    scaled = np.floor(flat[fine] * scale)
    if scaled.size and np.abs(scaled).max() > MOST:
        raise ValueError(f"a component beyond {MOST} after scaling: its squared distance may not fit 64 bits")
    return rows_of(batch, "vec_id").take(pa.array(at[fine])), scaled.astype(np.int64)


def _out(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    raw = np.ascontiguousarray(x, np.int32)
    blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (4 * x.shape[1])).astype(np.int32)), pa.py_buffer(raw)])
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), ids, blob, pa.array(cluster, pa.int32()), pa.array(distance), pa.nulls(n, pa.list_(pa.int64())), none, none], schema=_STATE)


class Totals:
    """Sums, counts and greatest squared distances of a task's clusters."""

    def __init__(self, k: int, dims: int):
        self.sums, self.members, self.far = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.compared = 0

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        for i in np.unique(cluster):
            own = cluster == i
            self.sums[i] += x[own].sum(axis=0)
            self.members[i] += own.sum()
            self.far[i] = max(self.far[i], int(distance[own].max()))

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.members)
        compared = np.where(np.arange(len(at)) == 0, self.compared, 0)
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(at), np.int32)), none, pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(self.far[at]), pa.array(list(self.sums[at]), pa.list_(pa.int64())), pa.array(self.members[at]), pa.array(compared)], schema=_STATE
        )


def _first(centroids: np.ndarray, dims: int, scale: int):
    """All vectors against all centroids, once: a walk over balls of which nothing is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, totals = Balls(centroids), Totals(len(centroids), dims)
        for batch in batches:
            ids, x = _integers(batch, dims, scale)
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                cluster, distance, n = balls.assign(part, np.zeros(len(part), np.int32))
                totals.add(part, cluster, distance)
                totals.compared += n
                yield _out(ids.slice(lo, len(part)), part, cluster, distance)
        yield totals.batch()

    return run


def _again(balls: Balls, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(balls.c), dims)
        for batch in batches:
            blob = batch.column(batch.schema.get_field_index("vector"))
            x = np.frombuffer(b"".join(blob.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
            ids, before = rows_of(batch, "vec_id"), rows_of(batch, "cluster").to_numpy()
            for lo in range(0, len(x), ROWS):
                part = x[lo : lo + ROWS]
                cluster, distance, n = balls.assign(part, before[lo : lo + ROWS])
                totals.add(part, cluster, distance)
                totals.compared += n
                yield _out(ids.slice(lo, len(part)), part, cluster, distance)
        yield totals.batch()

    return run


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The k whole-number vectors of smallest hash of salt and id, in that order; equal ids in the order of their components."""
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine).select(h.alias("h"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    return np.array([r.x for r in rows.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, dims)  # k is a parameter


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids after a round, the radii of the balls around them, and the members: a row a cluster and component comes back."""
    own = state.where("kind = 1")
    far = {r.cluster: (r.far, r.members) for r in own.groupBy("cluster").agg(F.max("distance").alias("far"), F.sum("members").alias("members")).collect()}
    sums = own.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s")).collect()
    new, radii, members = centroids.copy(), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in sums:
        new[r.cluster, r["at"]] = r.s // far[r.cluster][1]  # floor, of negative sums, too
    for i, (d, n) in far.items():
        shift = math.sqrt(int(((new[i] - centroids[i]) ** 2).sum()))
        radii[i], members[i] = (math.sqrt(d) + shift) * (1 + 1e-9) + 1e-6, n
    return new, radii, members


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, stored, and the final centroids."""
    spark: SparkSession = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = first_centroids(v, k, dims, scale, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    state = stored(v.mapInArrow(lean(_first(centroids, dims, scale)), _STATE_SQL), "balls", compression="zstd")
    for _ in range(rounds):
        centroids, radii, _members = _moved(state, centroids)
        new = stored(state.where("kind = 0").mapInArrow(lean(_again(Balls(centroids, radii), dims)), _STATE_SQL), "balls", compression="zstd")
        spent(state)
        state = new
    return state.where("kind = 0").select("vec_id", "cluster", "distance"), centroids


def digest(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    rows, centroids = cluster(vectors, **how)
    hashes = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = rows.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string").join(each, "cluster")
    told = told.join(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia"))), how="cross")
    # One row a cluster, whose number is a parameter.
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
