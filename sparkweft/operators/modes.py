"""Retrieval modes as lazy plans: beam walks, focused anchors and edges, local and mixed search."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators import graph as G
from sparkweft.operators import lexical as L
from sparkweft.operators import vector as V
from sparkweft.sources.store import spent, stored


def beam_candidates(frontier: DataFrame, adjacency: DataFrame, seen: DataFrame, vectors: DataFrame, query: DataFrame, depth: int, threshold: float | None, weights: tuple[float, float, float, float], linear: bool = False) -> DataFrame:
    """Scored steps (nbr, parent, sem, score) from ``frontier(node, score)`` over ``adjacency(node, nbr, weight)`` to nodes not yet seen. Only neighbours' vectors are compared."""
    sem, path, weight, length = weights
    step = adjacency.join(F.broadcast(frontier), "node").join(F.broadcast(seen.select(F.col("node").alias("nbr"))), "nbr", "left_anti")
    step = step.join(vectors.select(F.col("name").alias("nbr"), "v"), "nbr", "left").join(F.broadcast(query.limit(1)), how="cross")
    step = step.withColumn("sem", F.coalesce(F.round(V.cosine(F.col("v"), F.col("q")), 6), F.lit(0.0)))
    score = sem * F.col("sem") + path * F.col("score") + weight * F.least(F.col("weight") / 10, F.lit(1.0)) - length * (depth if linear else log(depth + 1))
    out = step.select("nbr", F.col("node").alias("parent"), "sem", F.round(score, 6).alias("score"))
    return out if threshold is None else out.where(F.col("score") >= threshold)


def beam(adjacency: DataFrame, vectors: DataFrame, query: DataFrame, anchors: DataFrame, hops: int = 2, width: int = 5, threshold: float | None = 0.35, top_k: int = 10, weights=(0.6, 0.2, 0.1, 0.1), stop: float = 0.8, linear: bool = False) -> DataFrame:
    """(node, score, hop, parent): a beam walk from ``anchors(node, score)`` over ``adjacency(node, nbr, weight)``.

    Neighbours are compared with ``query(q)`` by their vectors in
    ``vectors(name, v)``. A hop keeps the best ``width`` steps for each
    frontier node, the best step into each node, and leaves the graph's other
    steps unseen; later hops are narrower. The walk ends early once one of the
    three best steps is close to the query. A frontier is at most width times
    the last one, the first as long as the anchors, so it may be broadcast;
    every hop is written out. With ``linear`` a hop costs its depth, not the
    logarithm; without a threshold no step is left out for its score.
    """
    found = anchors.select("node", F.col("score").cast("double").alias("score"), F.lit(0).cast("long").alias("hop"), F.lit(None).cast("string").alias("parent"))
    frontier = stored(found, "beam")
    found = frontier
    for depth in range(1, hops + 1):
        n = frontier.count()
        if not n:
            break
        wide = width if depth == 1 else max(width - 2, 2)
        steps = stored(beam_candidates(frontier.select("node", "score"), adjacency, found, vectors, query, depth, threshold, weights, linear).orderBy(F.desc("score"), "nbr", "parent").limit(wide * n), "steps")
        best = F.row_number().over(Window.partitionBy("nbr").orderBy(F.desc("score"), "parent"))
        frontier = stored(steps.withColumn("_n", best).where("_n = 1").select(F.col("nbr").alias("node"), "score", F.lit(depth).cast("long").alias("hop"), "parent"), "beam")
        found = found.unionByName(frontier)
        near = depth < hops and steps.orderBy(F.desc("score"), "nbr", "parent").limit(3).where(F.col("sem") >= stop).limit(1).count()
        spent(steps)
        if near:
            break
    return found.orderBy(F.desc("score"), "hop", "node").limit(max(4 * top_k, 20))


def beam_anchors(semantic: DataFrame, lexical: DataFrame, relations: DataFrame, top_k: int, alpha: float = 0.6) -> DataFrame:
    """(node, score) of the entities that a beam starts from: the best of a list by similarity ``(name, pos)`` and one by words ``(id, score)``, then ends of the best relations ``(pos, src, tgt)``, a tenth less each, down to ``min(top_k, 10)`` entities."""
    k = min(top_k, 10)
    both = L.weighted(semantic.select(F.col("name").alias("id"), "pos"), lexical, alpha, 2 * k).select(F.col("id").alias("node"), "score")
    ends = relations.select(F.explode(F.array("src", "tgt")).alias("node"), F.round(F.lit(0.9) / F.col("pos"), 6).alias("score"))
    return both.unionByName(ends).groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(k)


def rerank_anchors(anchors: DataFrame, scores: DataFrame, least: float = 0.01, k: int = 10) -> DataFrame:
    """The ``k`` anchors that a reranker's ``scores(node, score)`` puts first, none under ``least``; those it did not see keep their score."""
    s = anchors.join(scores.select("node", F.col("score").alias("_s")), "node", "left").withColumn("score", F.coalesce("_s", "score")).drop("_s")
    return s.where(F.col("score") >= least).orderBy(F.desc("score"), "node").limit(k)


def fallback_anchors(names: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Anchors found by vector alone, ``names(name, score)``, that are nodes, with their degree; the score is the similarity."""
    return names.join(nodes.select("name"), "name", "left_semi").join(degrees.select(F.col("node").alias("name"), "degree"), "name", "left").select(F.col("name").alias("node"), "score", F.coalesce("degree", F.lit(0)).alias("degree"))


def focused_anchors(words: L.Index, entities: DataFrame, keywords: DataFrame, k: int, per_keyword: int, threshold: float = 0.7, bonus: float = 0.1) -> DataFrame:
    """(name, score) of the best anchors of ``entities(name, v)`` for ``keywords(kw, terms, q)``; words: the entities' index by name.

    Each keyword takes its best entities by words and by similarity. An entity
    found both ways gets a bonus. Scores fold over the keywords in order, each
    entity on its own: the greatest similarity so far, then the bonus, at most 1.
    One plan serves all keywords.
    """
    lex = L.top_each(words, keywords.select("kw", F.explode("terms").alias("term")), per_keyword).select("kw", F.col("id").alias("name"), F.lit(True).alias("lex"))
    sims = entities.select("name", "v").join(F.broadcast(keywords.select("kw", "q")), how="cross").select("kw", "name", F.round(V.cosine(F.col("v"), F.col("q")), 6).alias("sim"))
    order = Window.partitionBy("kw").orderBy(F.desc("sim"), "name")
    # As many by similarity as four times the quota and one for each found by words: five quotas at most.
    near = sims.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 5 * per_keyword)
    near = near.join(F.broadcast(lex.groupBy("kw").agg(F.count(F.lit(1)).alias("_lex"))), "kw", "left").where(F.col("_n") <= 4 * per_keyword + F.coalesce("_lex", F.lit(0)))
    near = near.select("kw", "name", "sim", F.lit(True).alias("near"))
    both = near.join(sims.join(F.broadcast(lex), ["kw", "name"]).withColumnRenamed("sim", "_sim"), ["kw", "name"], "full_outer")
    no = F.lit(False)
    j = both.select("kw", "name", F.coalesce("sim", "_sim").alias("sim"), F.coalesce("near", no).alias("near"), F.coalesce("lex", no).alias("lex"))
    # How many entities found by similarity alone come before.
    alone = F.when(F.col("near") & ~F.col("lex") & (F.col("sim") >= threshold), 1).otherwise(0)
    ahead = F.coalesce(F.sum(alone).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = j.withColumn("taken", F.col("near") & (F.col("sim") >= threshold) & (ahead < per_keyword)).where("lex or taken")
    steps = F.array_sort(F.collect_list(F.struct("kw", "sim", "lex", "taken")))

    def fold(acc, s):
        top = F.greatest(acc, s.sim)
        return F.when(s.lex & s.taken, F.least(top + bonus, F.lit(1.0))).otherwise(top)

    pool = every.groupBy("name").agg(steps.alias("s")).select("name", F.round(F.aggregate("s", F.lit(-1.0), fold), 6).alias("score"))
    return pool.orderBy(F.desc("score"), "name").limit(k)


def focused_edges(anchors: DataFrame, relations: DataFrame, alpha: float = 0.5, beta: float = 0.5, threshold: float = 0.3, quota: int = 5, most: int = 30) -> DataFrame:
    """The best edges of ``anchors(pos, node, score)`` among ``relations(src, tgt, weight, sim)``.

    An edge's score joins its anchor's and its own similarity. Every anchor
    gives at most ``quota`` edges; an edge given twice counts for the first
    anchor.
    """
    r = relations.where(F.col("sim") >= threshold)
    both = r.select(F.col("src").alias("node"), "*").unionByName(r.select(F.col("tgt").alias("node"), "*"))
    j = both.join(F.broadcast(anchors.select("pos", "node", "score")), "node").withColumn("joint", F.round(alpha * F.col("score") + beta * F.col("sim"), 6))
    j = G.top_per(j, "pos", quota, F.desc("joint"), "src", "tgt")
    first = F.row_number().over(Window.partitionBy("src", "tgt").orderBy("pos"))
    j = j.withColumn("_n", first).where("_n = 1")
    return j.select("src", "tgt", "weight", "sim", F.col("node").alias("anchor"), "joint").orderBy(F.desc("joint"), "src", "tgt").limit(most)


def unfiltered_edges(anchors: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The first edges in order of discovery: anchor by anchor, each edge once."""
    both = edges.select(F.col("src").alias("node"), "src", "tgt", "weight").unionByName(edges.select(F.col("tgt").alias("node"), "src", "tgt", "weight"))
    j = both.join(F.broadcast(anchors.select("pos", "node")), "node")
    first = j.groupBy("src", "tgt").agg(F.min("pos").alias("pos"), F.first("weight").alias("weight"))
    return first.orderBy("pos", "src", "tgt").limit(most)


def anchors_kept(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchors that still have an edge."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    return anchors.join(ends, "node", "left_semi")
