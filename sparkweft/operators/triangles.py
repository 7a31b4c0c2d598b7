"""Triangles without wedges between tasks: edges dealt to triples of colours.

A node has one of ``p`` colours by its hash. A task owns three colours (with
repetition) and gets the edges between them, some ``9 / p^2`` of all; a
triangle belongs to the one task that owns just its three colours. ``p`` is
chosen by the number of edges, so that a task's part is bounded whatever the
graph, and every edge is moved ``p`` times; a hub's edges are dealt out by the
colours of their other ends. Inside a task edges run from the end of smaller
degree, and pairs of a node's targets are looked up a slice at a time.

Beyond ``COLOURS`` colours this moves too much, and lists are compared instead:
nodes are numbered by degree, each node lists its greater neighbours, which are
at most a root of twice the edges, and each edge gets two bytes for each entry
of its greater end's list. Entries of its smaller end's list with such bytes
are candidates, which are looked up among the edges. What is moved grows with
the edges times the lengths of lists, not with their number to the power 1.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.operators import graph as G
from sparkweft.operators.ranking import numbered
from sparkweft.sources.store import spent, stored

#: Edges of a task, about, and pairs looked up at once.
TASK_EDGES, PAIRS = 1_000_000, 2_000_000
#: Colours, so copies of each edge, at most.
COLOURS = 6


def colours_for(edges: int, most: int = TASK_EDGES) -> int:
    """How many colours keep a task's ``9 / p^2`` of the edges below ``most``."""
    return max(1, math.ceil(3 * math.sqrt(edges / most)))


def closed_pairs(u: np.ndarray, v: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, c) of every triangle of the edges between nodes 0 to n - 1, each once, a slice at a time. Edges stand once, without loops."""
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    swap = (degree[u] > degree[v]) | ((degree[u] == degree[v]) & (u > v))
    a, b = np.where(swap, v, u).astype(np.int64), np.where(swap, u, v).astype(np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keys = a * n + b  # sorted
    ends = np.searchsorted(a, a, side="right")
    # Edge i is paired with the later edges of its start: as many as end - i - 1.
    many = ends - np.arange(len(a)) - 1
    total = np.cumsum(many)
    lo = 0
    while lo < len(a):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        count = many[lo:hi]
        first = np.repeat(np.arange(lo, hi), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        x, y = b[first], b[second]
        for p, q in ((x, y), (y, x)):  # the closing edge may run either way
            wanted = p * n + q
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            yield a[first[hit]], p[hit], q[hit]
        lo = hi


def _count(table: pa.Table) -> pa.Table:
    """Triangles of a task's edges at each node, of those whose colours are just the task's."""
    own = tuple(sorted(int(table[c][0].as_py()) for c in ("x", "y", "z")))
    names = pa.concat_arrays([table["src"].combine_chunks(), table["tgt"].combine_chunks()]).dictionary_encode()
    ids, n = names.indices.to_numpy(), len(names.dictionary)
    u, v = ids[: len(table)], ids[len(table) :]
    colour = np.zeros(n, np.int64)
    colour[u], colour[v] = table["cs"].to_numpy(), table["ct"].to_numpy()
    found = np.zeros(n, np.int64)
    for corners in closed_pairs(u, v, n):
        kinds = np.sort(np.stack([colour[c] for c in corners]), axis=0)
        mine = (kinds == np.array(own)[:, None]).all(axis=0)
        for c in corners:
            found += np.bincount(c[mine], minlength=n)
    at = np.flatnonzero(found)
    return pa.table([names.dictionary.take(pa.array(at)), pa.array(found[at])], names=["node", "triangles"])


def _by_colours(once: DataFrame, p: int) -> DataFrame:
    """(node, triangles) by tasks of three out of ``p`` colours."""
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    dealt = once.withColumns({"cs": colour("src"), "ct": colour("tgt")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
    x, y, z = (F.sort_array(F.array("cs", "ct", "other"))[i].alias(c) for i, c in enumerate("xyz"))
    each = dealt.select("src", "tgt", "cs", "ct", x, y, z).groupBy("x", "y", "z").applyInArrow(_count, "node string, triangles long")
    return stored(each.groupBy("node").agg(F.sum("triangles").alias("triangles")), "triangles")


def _mark(v: Column) -> Column:
    """Two bytes that tell most numbers apart."""
    return F.shiftright(F.xxhash64(v), 48).cast("short")


def _by_lists(once: DataFrame) -> DataFrame:
    """(node, triangles) by comparing the lists of edges' ends."""
    counted = numbered(G.degrees(once), "degree", "node", name="id")
    ids = stored(counted.select("node", "id"), "ids")
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("tgt"), F.col("id").alias("b"))
    runs = stored(once.join(a, "src").join(b, "tgt").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), "runs")
    lists = stored(runs.groupBy("u").agg(F.collect_list("v").alias("vs")).withColumn("marks", F.transform("vs", _mark)), "lists")
    asked = runs.join(lists.select(F.col("u").alias("v"), F.col("marks").alias("theirs")), "v")
    both = asked.join(lists, "u").withColumn("hits", F.array_intersect("marks", "theirs")).where(F.size("hits") > 0)
    wanted = both.select("u", "v", F.explode(F.filter("vs", lambda w: F.array_contains(F.col("hits"), _mark(w)))).alias("w"))
    found = wanted.join(runs.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    n = found.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    out = stored(n.join(ids, "id").select("node", "triangles"), "triangles")
    spent(counted, ids, runs, lists)
    return out


def _triangles(once: DataFrame, most: int) -> DataFrame:
    p = colours_for(once.count(), most)
    return _by_colours(once, p) if p <= COLOURS else _by_lists(once)


def triangles(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """(node, triangles) of every node in one. ``edges(src, tgt)`` hold strings and are undirected; loops, nulls and repeated edges count for nothing."""
    once = stored(edges.where("src <> tgt").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct(), "edges")
    out = _triangles(once, most)
    spent(once)
    return out


def clustering(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """(node, degree, triangles, coefficient) of ``edges(src, tgt)``, which stand once each and are no loops."""
    once = stored(edges.select("src", "tgt"), "edges")
    degrees = stored(G.degrees(once), "degrees")
    j = degrees.join(_triangles(once, most), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    spent(once)
    pairs = F.col("degree") * (F.col("degree") - 1)
    return j.withColumn("coefficient", F.round(F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(0.0), 6))
