"""Many questions in one plan give what each gives alone."""

import random

from pyspark.sql import functions as F

from sparkweft.operators import graph, many, modes, vector


def data(spark, seed, nodes=50):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(nodes), 2))) for _ in range(160)})
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", float(r.randrange(1, 20))) for a, b in pairs], "src string, tgt string, weight double")
    vecs = spark.createDataFrame([(i, f"n{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(nodes) if i % 9], "id long, name string, v array<double>")
    ask = spark.createDataFrame([(f"q{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(6)] + [("empty", [0.0] * 4)], "qid string, q array<double>")
    return edges, vecs, ask


def tell(df, *drop):
    return sorted(map(str, (tuple(v for c, v in r.asDict().items() if c not in drop) for r in df.collect())))


def test_as_alone(spark, monkeypatch):
    edges, vecs, ask = data(spark, 2)
    adj = graph.adjacency(edges)
    top = many.top_many(vecs, ask, 3)
    anchors = top.select("qid", F.col("name").alias("node"), F.lit(1.0).alias("score"))
    walks = many.beam_many(adj, vecs, ask, anchors, hops=3, width=3, threshold=0.1, top_k=5, stop=0.97)
    rel = edges.join(vecs.select(F.col("name").alias("src"), "v"), "src")
    picked = many.focused_many(top.select("qid", "pos", F.col("name").alias("node"), "score"), rel, ask, 0.6, 0.4, 0.1, 2, 4)
    got = {k: tell(df) for k, df in (("top", top.select("qid", "id", "score")), ("walk", walks), ("edges", picked))}
    want = {"top": [], "walk": [], "edges": []}
    stopped = set()
    for q in ask.collect():
        one = spark.createDataFrame([(q.q,)], "q array<double>")
        mine = vector.ranked(vector.top_k(vecs, one, 3), F.desc("score"), "id")
        want["top"] += tell(mine.select(F.lit(q.qid).alias("qid"), "id", "score"))
        own = mine.select(F.col("name").alias("node"), F.lit(1.0).alias("score"))
        walk = modes.beam(adj, vecs, one, own, hops=3, width=3, threshold=0.1, top_k=5, stop=0.97)
        stopped.add(max(r.hop for r in walk.collect()))
        want["walk"] += tell(walk.select(F.lit(q.qid).alias("qid"), "node", "score", "hop", "parent"))
        sims = vector.scored(rel, one).withColumnRenamed("score", "sim").drop("v")
        want["edges"] += tell(modes.focused_edges(mine.select("pos", F.col("name").alias("node"), "score"), sims, 0.6, 0.4, 0.1, 2, 4).select(F.lit(q.qid).alias("qid"), "src", "tgt", "weight", "sim", "anchor", "joint"))
    assert {k: sorted(v) for k, v in want.items()} == got
    assert len(stopped) > 1  # some questions end early, others go on


def test_nothing_is_broadcast_beyond_the_bound(spark, monkeypatch):
    edges, vecs, ask = data(spark, 3, nodes=30)
    anchors = many.top_many(vecs, ask, 2).select("qid", F.col("name").alias("node"), F.lit(1.0).alias("score"))
    run = lambda: tell(many.beam_many(graph.adjacency(edges), vecs, ask, anchors, width=2, threshold=None))
    few = run()
    monkeypatch.setattr(many, "FEW", 0)
    assert run() == few
    none = ask.where("qid = 'nobody'")
    assert many.beam_many(graph.adjacency(edges), vecs, none, anchors.where("qid = 'nobody'")).count() == 0
