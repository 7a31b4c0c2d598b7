import random

from sparkweft.llm import components as C


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = C.components(df).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.root for r in got}


def test_against_union_find(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)]
    clean = [(u, v) for u, v in edges if u != v]
    assert run(spark, [*edges, (None, 3), (7, None)]) == plain(clean)
    # Nodes of a few edges are hubs already.
    monkeypatch.setattr(C, "HUB_EDGES", 2)
    assert run(spark, edges) == plain(clean)
    assert run(spark, []) == {} and run(spark, [(1, 1)]) == {}
