"""Connected components of an edge table, by alternating large and small stars.

Every round is a handful of joins and minima whose result is written to the
shared folder, so a lost executor costs a round's tasks, not the loop; the
round before is deleted then. A hub's edges are never gathered: minima are
taken before they are moved, and the few nodes of very many edges meet theirs
by a broadcast, where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import spent, stored

#: A hub has this many edges, and at least one in ``HUBS`` of all: so hubs are ``2 * HUBS`` at most.
HUB_EDGES, HUBS = 1000, 50_000


def _with_low(e: DataFrame, low: DataFrame, least: int | None) -> DataFrame:
    """``e`` and its u's least neighbour m, of ``low(u, m, edges)``; nodes of ``least`` edges are hubs, None: there are none."""
    if least is None:
        return e.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.where(F.col("edges") >= least).select("u", "m"))
    told = e.join(hubs, "u", "left")
    rest = told.where("m is null").drop("m").join(low.where(F.col("edges") < least).select("u", "m"), "u")
    return told.where("m is not null").unionByName(rest)


def _low(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges"))


def _large_star(e: DataFrame, least: int | None) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _low(both).select("u", F.least("m", "u").alias("m"), "edges")
    return _with_low(both.where("v > u"), low, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, least: int | None) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _low(down)
    kept = _with_low(down, low, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    """(edges, sum over their hashes, most edges of a node): the sum moves whenever any edge does."""
    ends = e.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
    each = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    return tuple(each.agg(F.coalesce(F.sum("n") / 2, F.lit(0)).cast("long"), F.sum("h"), F.max("n")).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node of its component.

    Self-loops and edges with a null are dropped. An empty table gives an
    empty result.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna()
    e = stored(edges.where("u != v").distinct(), "edges")
    before, now = None, _state(e)
    for _ in range(max_rounds):
        if now == before or not now[0]:
            break
        before = now
        least = max(HUB_EDGES, 2 * now[0] // HUBS)
        least = least if now[2] >= least else None
        new = stored(_small_star(_large_star(e, least), least), "stars")
        spent(e)
        e, now = new, _state(new)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
