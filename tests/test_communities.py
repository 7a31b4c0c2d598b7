"""Triangles by colours and communities by modularity."""

import itertools
import random

import numpy as np

from sparkweft.operators import graph as G
from sparkweft.operators import louvain as V
from sparkweft.operators import triangles as T


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src string, tgt string, weight double")


def plain(pairs):
    near = {}
    for a, b, *_ in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {x: sum(q in near[p] for p, q in itertools.combinations(sorted(n), 2)) for x, n in near.items()}
    return {x: n for x, n in out.items() if n}


def test_triangles(spark):
    r = random.Random(2)
    pairs = [(f"n{a}", f"n{b}", 1) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(500))] + [("hub", f"n{i}", 1) for i in range(60)]
    want = plain(pairs)
    for most in (10**6, 200):  # one task, and several colours
        assert {x.node: x.triangles for x in T.triangles(frame(spark, pairs), most).collect()} == want
    once = sorted({(min(a, b), max(a, b), 1) for a, b, _ in pairs if a != b})
    old = {tuple(x) for x in G.clustering(frame(spark, once)).select("node", "degree", "triangles", "coefficient").collect()}
    assert {tuple(x) for x in T.clustering(frame(spark, once), 200).select("node", "degree", "triangles", "coefficient").collect()} == old
    assert T.triangles(frame(spark, [("a", "b", 1)])).count() == 0 and T.triangles(frame(spark, [])).count() == 0


def test_slices_and_shares(monkeypatch):
    monkeypatch.setattr(T, "PAIRS", 7)
    r = np.random.default_rng(1)
    u, v = np.triu_indices(25, 1)
    keep = r.random(len(u)) < 0.5
    u, v = u[keep], v[keep]
    found = sorted(tuple(sorted(map(int, t))) for abc in T.closed_pairs(u, v, 25) for t in zip(*abc))
    edges = set(zip(u.tolist(), v.tolist()))
    assert found == [t for t in itertools.combinations(range(25), 3) if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= edges]
    for e in (10**6, 10**8, 10**10):
        p = T.colours_for(e)
        assert 9 * e / p**2 <= T.TASK_EDGES


def q_of(pairs, of):
    m2 = 2 * sum(w for _, _, w in pairs)
    k, inside = {}, {}
    for a, b, w in pairs:
        for x in (a, b):
            k[of[x]] = k.get(of[x], 0) + w
        if of[a] == of[b]:
            inside[of[a]] = inside.get(of[a], 0) + 2 * w
    return sum(inside.get(c, 0) / m2 - (k[c] / m2) ** 2 for c in k)


def test_planted_communities(spark):
    r = random.Random(5)
    group = lambda i: i // 8
    pairs = sorted({(f"n{a:02}", f"n{b:02}", 1.0) for a, b in itertools.combinations(range(40), 2) if r.random() < (0.9 if group(a) == group(b) else 0.03)})
    trace = []
    found = {x.node: x.community for x in V.louvain(frame(spark, pairs), trace=trace).collect()}
    assert all(found[f"n{i:02}"] == f"n{8 * group(i):02}" for i in range(40))
    assert trace == sorted(trace) and abs(trace[-1] - q_of(pairs, found)) < 1e-9
    assert abs(V.modularity(frame(spark, pairs), spark.createDataFrame(list(found.items()), "node string, community string")) - trace[-1]) < 1e-9


def test_a_star_joins_at_once(spark):
    """A hub that all want to join takes them in a few rounds; weights and loops count, an empty graph has nothing."""
    pairs = [("hub", f"leaf{i:03}", 1.0) for i in range(120)]
    trace = []
    found = {x.community for x in V.louvain(frame(spark, pairs), rounds=10, levels=2, trace=trace).collect()}
    assert len(found) < 30 and trace == sorted(trace)
    assert V.louvain(frame(spark, [])).count() == 0
    assert {x.community for x in V.louvain(frame(spark, [("a", "b", 5.0), ("b", "c", 0.0), ("c", "c", 2.0)])).collect()} == {"a", "c"}
