"""Communities by modularity: moves in rounds, contraction, and again.

A round looks at every node's best move by its gain in modularity. Moves made
at once disturb each other: a community that some leave is no place to come to,
so a coin per community and round lets it either lose or win members; and
movers that share where they come from, or where they go, take from each
other's gains at most the product of their degrees over 2 m^2. In the order of
their gains, a mover goes if its gain outweighs what all before it may take. So
the gains of a round add up to no more than what modularity rises by, and it
never falls. When rounds bring nothing, communities become the nodes of a
smaller graph, until none merge.

Every round is a few joins and partial sums, written to the shared folder; a
node's neighbours are counted by community before they are moved. Of the
movers between two rounds at most ``MOVERS`` of a community go at once; the
others wait.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.sources.store import spent, stored

MOVERS = 100_000
#: Gains in units of 2 m below this are none.
LEAST = 1e-9


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of ``labels(node, community)`` on the undirected ``edges(src, tgt, weight)``."""
    return _modularity(_both(edges), labels, resolution)


def _both(edges: DataFrame) -> DataFrame:
    """(node, nbr, w) both ways, summed; a loop counts twice at its node."""
    e = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("weight").cast("double").alias("w")).where("w > 0")
    return e.union(e.select("b", "a", "w")).groupBy(F.col("a").alias("node"), F.col("b").alias("nbr")).agg(F.sum("w").alias("w"))


def _modularity(adj: DataFrame, labels: DataFrame, resolution: float) -> float:
    of = labels.select("node", "community")
    j = adj.join(of, "node").join(of.select(F.col("node").alias("nbr"), F.col("community").alias("c2")), "nbr")
    total = j.agg(F.sum("w").alias("t")).first().t
    if not total:
        return 0.0
    each = j.groupBy("community").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("community") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"))
    return each.agg(F.sum(F.col("inside") / total - resolution * (F.col("k") / total) ** 2).alias("q")).first().q


def _moves(adj: DataFrame, state: DataFrame, total: float, turn: int, resolution: float) -> DataFrame:
    """(node, to) of the moves of a round over ``state(node, community, k)``."""
    near = adj.where("node <> nbr").join(state.select(F.col("node").alias("nbr"), F.col("community").alias("c")), "nbr").groupBy("node", "c").agg(F.sum("w").alias("w"))
    weight = state.groupBy("community").agg(F.sum("k").alias("all"))
    own = state.join(weight, "community")
    mine = own.join(near.select("node", F.col("c").alias("community"), F.col("w").alias("w0")), ["node", "community"], "left")
    # What it has where it is, without itself; in units of 2 m.
    mine = mine.select("node", "community", "k", (F.coalesce("w0", F.lit(0.0)) - resolution * F.col("k") * (F.col("all") - F.col("k")) / total).alias("stay"))
    there = near.join(weight.select(F.col("community").alias("c"), F.col("all").alias("call")), "c").join(mine, "node").where("c <> community")
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    gain = F.col("w") - resolution * F.col("k") * F.col("call") / total - F.col("stay")
    can = there.where((coin("community") == 0) & (coin("c") == 1)).withColumn("gain", gain).where(F.col("gain") > LEAST)
    best = can.groupBy("node", "community", "k").agg(F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b")).select("node", "k", F.col("community").alias("from"), F.col("b.c").alias("to"), (-F.col("b.g")).alias("gain"))
    for side in ("from", "to"):
        best = best.withColumn("_n", F.row_number().over(Window.partitionBy(side).orderBy(F.desc("gain"), "node"))).where(F.col("_n") <= MOVERS).drop("_n")
        before = Window.partitionBy(side).orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)
        best = best.withColumn(f"_{side}", F.coalesce(F.sum("k").over(before), F.lit(0.0)))
    return best.where(F.col("gain") > resolution * F.col("k") * (F.col("_from") + F.col("_to")) / total).select("node", "to")


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 24, quiet: int = 4, resolution: float = 1.0, trace: list | None = None) -> DataFrame:
    """(node, community) of the nodes of ``edges(src, tgt, weight)``; a community is named by its smallest node.

    A level ends after ``rounds``, or ``quiet`` rounds without a move. With
    ``trace`` each level's modularity is appended. Weights that are null or not
    positive are no edges; an empty graph has no communities.
    """
    adj = stored(_both(edges.where("src is not null and tgt is not null")), "graph")
    total = adj.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("t")).first().t
    out = stored(adj.select("node").distinct().select("node", F.col("node").alias("community")), "communities")
    if not total:
        return out
    level = adj
    for _ in range(levels):
        state = stored(level.groupBy("node").agg(F.sum("w").alias("k")).select("node", F.col("node").alias("community"), "k"), "level")
        still = moved = 0
        for turn in range(rounds):
            moves = stored(_moves(level, state, total, turn, resolution), "moves")
            n = moves.count()
            if n:
                new = stored(state.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k"), "level")
                spent(state)
                state = new
            spent(moves)
            moved, still = moved + n, 0 if n else still + 1
            if still >= quiet:
                break
        if moved:
            name = state.groupBy("community").agg(F.min("node").alias("name"))
            of = stored(state.join(name, "community").select("node", F.col("name").alias("to")), "names")
            new = stored(out.join(of.withColumnRenamed("node", "community"), "community").select("node", F.col("to").alias("community")), "communities")
            smaller = level.join(of, "node").join(of.select(F.col("node").alias("nbr"), F.col("to").alias("to2")), "nbr").groupBy(F.col("to").alias("node"), F.col("to2").alias("nbr")).agg(F.sum("w").alias("w"))
            smaller = stored(smaller, "graph")
            spent(out, of, *([level] if level is not adj else []))
            out, level = new, smaller
        spent(state)
        if trace is not None:
            trace.append(_modularity(adj, out, resolution))
        if not moved:
            break
    name = out.groupBy("community").agg(F.min("node").alias("name"))
    named = stored(out.join(name, "community").select("node", F.col("name").alias("community")), "communities")
    spent(out, adj, *([level] if level is not adj else []))
    return named
