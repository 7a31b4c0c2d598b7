"""Retrieval for a table of questions in one plan: frontiers, limits and ranks are kept by question.

Every frame has a column ``qid``. Hops, joins and writes are those of one
question, whatever their number; nothing is counted by question on the driver.
A side is broadcast only once its rows have been counted and are few; beyond
that the joins shuffle. Questions and anchors hold no null ``qid``.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators.vector import cosine
from sparkweft.sources.store import spent, stored

#: Rows of a broadcast at most.
FEW = 200_000
#: Questions compared with a vector at once.
BLOCK = 256


def _light(df: DataFrame) -> DataFrame:
    """A stored frame, to be broadcast where its rows are few."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def best(df: DataFrame, key: str | list[str], n: int | Column, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key; each task keeps its own first before rows meet where ``n`` is a number."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def top_many(vectors: DataFrame, questions: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(qid, pos, id, score, other columns) of the ``k`` most similar of ``vectors(id, v, ...)`` for each of ``questions(qid, q)``, ties to the smaller id.

    Questions go to the vectors in blocks, each block a row; a task holds one
    block's scores for a vector at a time and its own k best of each question.
    """
    blocks = questions.withColumn("_b", F.floor(F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("qid"), F.lit(64))).orderBy("qid")) / BLOCK)).groupBy(F.pmod(F.xxhash64("qid"), F.lit(64)).alias("_h"), "_b").agg(F.collect_list(F.struct("qid", "q")).alias("_qs")).select("_qs")
    blocks = _light(stored(blocks, "questions"))
    s = vectors.join(blocks, how="cross").withColumn("_q", F.explode("_qs")).withColumn("score", F.round(cosine(F.col("v"), F.col("_q.q")), 6)).withColumn("qid", F.col("_q.qid")).drop("_qs", "_q", "v")
    if threshold is not None:
        s = s.where(F.col("score") >= threshold)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return s.withColumn("pos", place.cast("long")).where(F.col("pos") <= k)


def beam_many(adjacency: DataFrame, vectors: DataFrame, questions: DataFrame, anchors: DataFrame, hops: int = 2, width: int = 5, threshold: float | None = 0.35, top_k: int = 10, weights: tuple[float, float, float, float] = (0.6, 0.2, 0.1, 0.1), stop: float = 0.8, linear: bool = False) -> DataFrame:
    """(qid, node, score, hop, parent): for each of ``questions(qid, q)`` the walk of ``modes.beam`` from its ``anchors(qid, node, score)``.

    A question whose best steps come close to it takes no further hop; the
    others go on.
    """
    sem, path, weight, length = weights
    frontier = stored(anchors.select("qid", "node", F.col("score").cast("double").alias("score"), F.lit(0).cast("long").alias("hop"), F.lit(None).cast("string").alias("parent")), "beams")
    found = [frontier]
    ask = _light(stored(questions.select("qid", "q"), "questions"))
    for depth in range(1, hops + 1):
        wide = width if depth == 1 else max(width - 2, 2)
        step = adjacency.join(_light(frontier.select("qid", "node", "score")), "node")
        for f in found:
            step = step.join(_light(f.select("qid", F.col("node").alias("nbr"))), ["qid", "nbr"], "left_anti")
        # Vectors are fetched once a neighbour and compared once a question.
        step = step.join(vectors.select(F.col("name").alias("nbr"), "v"), "nbr", "left").join(ask, "qid")
        step = step.withColumn("sem", F.coalesce(F.round(cosine(F.col("v"), F.col("q")), 6), F.lit(0.0)))
        score = sem * F.col("sem") + path * F.col("score") + weight * F.least(F.col("weight") / 10, F.lit(1.0)) - length * (depth if linear else log(depth + 1))
        step = step.select("qid", "nbr", F.col("node").alias("parent"), "sem", F.round(score, 6).alias("score"))
        if threshold is not None:
            step = step.where(F.col("score") >= threshold)
        quota = frontier.groupBy("qid").agg((wide * F.count(F.lit(1))).alias("_quota"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "nbr", "parent"))
        steps = stored(step.withColumn("place", place).join(quota, "qid").where(F.col("place") <= F.col("_quota")).drop("_quota"), "steps")
        reached = best(steps, ["qid", "nbr"], 1, F.desc("score"), "parent").select("qid", F.col("nbr").alias("node"), "score", F.lit(depth).cast("long").alias("hop"), "parent")
        near = steps.where((F.col("place") <= 3) & (F.col("sem") >= stop)).select("qid").distinct()
        reached = stored(reached.join(near.withColumn("_near", F.lit(True)), "qid", "left"), "beams")
        spent(steps)
        found.append(reached)
        frontier = reached.where("_near is null")
        if depth < hops and frontier.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f.drop("_near"))
    return best(out, "qid", max(4 * top_k, 20), F.desc("score"), "hop", "node")


def focused_many(anchors: DataFrame, relations: DataFrame, questions: DataFrame, alpha: float = 0.5, beta: float = 0.5, threshold: float = 0.3, quota: int = 5, most: int = 30) -> DataFrame:
    """The best edges of each question's ``anchors(qid, pos, node, score)`` among ``relations(src, tgt, weight, v)``, as ``modes.focused_edges`` has them for one.

    Only relations of anchors are compared with ``questions(qid, q)``; a hub
    that many questions share is read once a question that has it.
    """
    near = _light(stored(anchors.select("qid", "pos", "node", "score"), "anchors"))
    both = relations.select(F.col("src").alias("node"), "src", "tgt", "weight", "v").unionByName(relations.select(F.col("tgt").alias("node"), "src", "tgt", "weight", "v"))
    j = both.join(near, "node").join(_light(stored(questions.select("qid", "q"), "questions")), "qid")
    j = j.withColumn("sim", F.round(cosine(F.col("v"), F.col("q")), 6)).where(F.col("sim") >= threshold).drop("v", "q")
    j = j.withColumn("joint", F.round(alpha * F.col("score") + beta * F.col("sim"), 6))
    j = best(best(j, ["qid", "pos"], quota, F.desc("joint"), "src", "tgt"), ["qid", "src", "tgt"], 1, "pos")
    j = best(j, "qid", most, F.desc("joint"), "src", "tgt")
    return j.select("qid", "src", "tgt", "weight", "sim", F.col("node").alias("anchor"), "joint")
