import math

import numpy as np
import pytest

from sparkweft.llm.ann import Rotations, hadamard, least_cosine, nearest, probes, search


def brute(rows, k, every):
    fit = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in fit:
        if q % every == 0:
            x = [(math.sqrt(math.fsum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in fit if i != q and len(w) == len(v)]
            out[q] = sorted(x)[:k]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    out = {}
    for r in sorted(search(df, **kw).collect()):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), atol=1e-5)
    assert np.allclose(hadamard(hadamard(x)), x, atol=1e-5)


def test_edge_rows(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(0, same), (1, same), (2, same), (3, same), (10, same), (20, [1.0, 2.0, 2.5]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 1.0]), (30, [1.0, 2.0]), (None, same), (11, [1e100, 1.0, 0.0]), (9, []), (1, same)]
    got = run(spark, rows, k=3, every=10)
    want = {q: v for q, v in brute(rows, 3, 10).items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert run(spark, []) == {}


def measured(spark, rows, **kw):
    """Recall against brute force, after checking that what was found is exact and in order."""
    x, ids = np.array([v for _, v in rows], np.float32).astype(float), np.array([i for i, _ in rows])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids.tolist(), x)], "vec_id long, embedding array<float>")
    got, hits, total = {}, 0, 0
    for r in sorted(search(df, **kw).collect()):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    asked = np.flatnonzero(ids % 100 == 0)
    assert got.keys() == set(ids[asked].tolist())
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)).tolist() if i != q][:10]
        found = got[int(ids[q])]
        assert len(found) == len(want) and found == sorted(found)
        assert all(np.isclose(s, d[np.flatnonzero(ids == v)[0]], rtol=1e-12) for s, v in found)
        hits += len({v for _, v in found} & set(ids[want].tolist()))
        total += len(want)
    return hits / total


def table(spark, sf):
    return sorted((r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    assert measured(spark, table(spark, sf)) >= 0.95


@pytest.mark.parametrize("spread", [0.5, 1.0])
def test_recall_with_unequal_lengths(spark, spread):
    r = np.random.default_rng(5)
    rows = [(i, (np.array(v) * np.exp(r.normal(0, spread))).tolist()) for i, v in table(spark, "sf0.1")]
    assert measured(spark, rows) >= 0.95


def test_near_copies(spark):
    """Rows that crowd round one direction, more than a part of a bucket holds, are told apart exactly."""
    r = np.random.default_rng(6)
    centre = r.normal(size=32)
    rows = [(i, (centre + 1e-3 * r.normal(size=32) if i % 3 else r.normal(size=32)).tolist()) for i in range(1500)]
    assert measured(spark, rows, rows_each=100) >= 0.95


def test_same_answer_on_any_cluster(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = sorted(search(df).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(search(df.repartition(7)).collect()) == want
        assert sorted(search(df, rows_each=10).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_probes():
    """More axes for weaker neighbours; none where no row can be near enough; the chance holds on fresh pairs."""
    p = probes(np.array([1.1, 0.9, 0.5, 0.3, -0.2]), 64, 8, 0.95)
    assert p[0] == 0 and 0 < p[1] <= p[2] <= p[3] and p[4] == 128
    assert (least_cosine(np.array([-30, 0, 30]), 0.0, 0.5) > 1).tolist() == [True, False, True]
    r, turn = np.random.default_rng(3), Rotations(64, 8)
    q, w = r.normal(size=(500, 64)), r.normal(size=(500, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    w -= (w * q).sum(axis=1, keepdims=True) * q
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    x, met = 0.5 * q + np.sqrt(0.75) * w, np.zeros(500, bool)
    for t in range(8):
        a, own = turn.coordinates(q, t), turn.coordinates(x, t).argmax(axis=1)
        met |= (a > a[np.arange(500), own][:, None]).sum(axis=1) < p[2]
    assert met.mean() >= 0.92


def test_many_ties():
    """Thousands of rows at one distance: the smallest ids stay, and no more than needed leave the bucket."""
    x = np.eye(3000, 16)[:16].repeat(200, axis=0) * 2.0
    low = np.random.default_rng(2).permutation(len(x))
    q = np.ones((3, 16))
    for bound in (np.inf, 10.0):
        i, j, d = (np.concatenate(c) for c in zip(*nearest(x, low, q, np.full(3, bound), 10)))
        for n in range(3):
            assert sorted(low[j[i == n]].tolist()) == list(range(11)) and np.allclose(d, np.sqrt(16))
