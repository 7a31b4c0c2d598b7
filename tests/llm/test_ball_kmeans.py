import hashlib
import math
import random

import numpy as np
import pytest

from sparkweft.llm import ball_kmeans as B

KIND = "vec_id long, embedding array<double>, label int, cluster string, kind string"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:k]]
    if not cents:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, own) if a == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, a in last if a == j) for j in range(len(cents))}
    return sorted((i is None, i or 0, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last))


def got(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], KIND).repartition(parts)
    out = B.digest(df, **how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def some(n, dims, seed, clusters=5, noise=0.1):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, dims))
    return [(int(i), [float(x) for x in mid[i % clusters] + noise * r.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("noise", [0.05, 1.0])
def test_against_all_pairs(spark, noise):
    rows = some(400, 64, 1, noise=noise)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    ok = some(30, 64, 2)
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, []), (104, [None] + [1.0] * 63), (105, [math.nan] + [1.0] * 63), (106, [math.inf] + [1.0] * 63), (107, [-math.inf] * 64)]
    same = [(3, ok[3][1]), (3, ok[3][1]), (None, ok[4][1]), (None, [0.5] * 64), (200, [0.0] * 64)]
    assert got(spark, ok + bad + same) == plain(ok + bad + same)


def test_ties_and_few(spark):
    # Whole lattices of equal distances: ties go to the smaller number; fewer vectors than centroids.
    r = random.Random(4)
    rows = [(i, [float(r.randrange(2))] * 2 + [float(r.randrange(2)), 0.0]) for i in range(60)]
    assert got(spark, rows, k=6, dims=4, scale=1) == plain(rows, k=6, dims=4, scale=1)
    assert got(spark, rows[:3], k=6, dims=4, scale=1) == plain(rows[:3], k=6, dims=4, scale=1)
    assert got(spark, []) == [] and got(spark, [(None, [1.0] * 64)]) == []


def test_refuses_what_no_long_holds(spark):
    with pytest.raises(Exception, match="squared distance"):
        got(spark, [(1, [1e30] * 64), (2, [0.0] * 64)])


def test_balls_compare_little():
    """Members of separate clusters lie in stable cores: after a move only their own centroid is looked at."""
    r = np.random.default_rng(0)
    cents = r.integers(-1000, 1000, (16, 8))
    own = np.repeat(np.arange(16, dtype=np.int32), 50)
    x = cents[own] + r.integers(-20, 21, (800, 8))
    far = np.array([math.sqrt(((x[own == i] - cents[i]) ** 2).sum(axis=1).max()) for i in range(16)])
    cluster, distance, compared = B.Balls(cents, far).assign(x, own)
    assert (cluster == own).all() and (distance == ((x - cents[own]) ** 2).sum(axis=1)).all()
    assert compared == 800
    # From any wrong start and without radii, the result is that of comparing everything.
    all_d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    cluster, distance, compared = B.Balls(cents).assign(x, r.integers(0, 16, 800).astype(np.int32))
    assert (cluster == all_d.argmin(axis=1)).all() and (distance == all_d.min(axis=1)).all() and compared < 800 * 16
