"""Property-graph operators over ``edges(src, tgt, weight, ...)``, stored once with src <= tgt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.sources.store import spent, stored


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr, weight): both directions."""
    w = [F.col("weight")] if "weight" in edges.columns else []
    return edges.select(F.col("src").alias("node"), F.col("tgt").alias("nbr"), *w).unionByName(edges.select(F.col("tgt").alias("node"), F.col("src").alias("nbr"), *w))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends are counted in one explode and one shuffle."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees of ``nodes(node)``, 0 for those without an edge."""
    return nodes.join(degrees(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def with_edge_degree(some: DataFrame, deg: DataFrame) -> DataFrame:
    """Edges and the sum of their ends' degrees."""
    s, t = deg.select(F.col("node").alias("src"), F.col("degree").alias("_s")), deg.select(F.col("node").alias("tgt"), F.col("degree").alias("_t"))
    zero = F.lit(0)
    return some.join(s, "src", "left").join(t, "tgt", "left").withColumn("edge_degree", F.coalesce("_s", zero) + F.coalesce("_t", zero)).drop("_s", "_t")


def edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes(node)``, each once."""
    n = nodes.select("node").distinct()
    one = edges.join(n, F.col("src") == F.col("node"), "left_semi")
    two = edges.join(n, F.col("tgt") == F.col("node"), "left_semi")
    return one.unionByName(two).dropDuplicates(["src", "tgt"])


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The induced subgraph."""
    n = nodes.select("node").distinct()
    return edges.join(n, F.col("src") == F.col("node"), "left_semi").join(n, F.col("tgt") == F.col("node"), "left_semi")


def edges_batch(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges asked for as ``pairs(a, b)`` in any direction; the asked direction is kept."""
    key = pairs.withColumn("src", F.least("a", "b")).withColumn("tgt", F.greatest("a", "b"))
    return key.join(edges, ["src", "tgt"]).drop("src", "tgt")


def popular(edges: DataFrame, limit: int = 300) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(limit)


def label_score(label: Column, query: str) -> Column:
    """How well a label answers a typed query: exact, prefix, or contained, the last better at a word's start."""
    low, q = F.lower(label), query.lower()
    inner = F.lit(100) - F.length(label) + F.when(F.concat(F.lit(" "), low).contains(f" {q}") | F.concat(F.lit("_"), low).contains(f"_{q}"), 50).otherwise(0)
    return F.when(low == q, 1000).when(low.startswith(q), 500).when(low.contains(q), inner).cast("long")


def search_labels(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best labels of ``nodes(node)`` for a query."""
    s = nodes.select("node", label_score(F.col("node"), query.strip()).alias("score"))
    return s.where("score is not null").orderBy(F.desc("score"), "node").limit(limit)


def bfs(edges: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, level) within ``depth`` hops of ``start(node)``; with ``most``, inner levels and greater degrees first.

    A join a hop against what is not yet seen; each level is written out, so a
    lost executor costs a level's tasks.
    """
    adj = adjacency(edges).select("node", "nbr")
    seen = start.select("node").distinct().withColumn("level", F.lit(0).cast("long"))
    front = seen
    for hop in range(1, depth + 1):
        new = front.join(adj, "node").select(F.col("nbr").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stored(new.withColumn("level", F.lit(hop).cast("long")), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    if most is None:
        return seen
    return node_degrees_of(seen, edges).orderBy("level", F.desc("degree"), "node").limit(most).drop("degree")


def node_degrees_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def rename(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges after nodes got other names by ``renames(old, new)``: ends rewired, loops dropped, edges that fall together merged (weights add up)."""
    a = renames.select(F.col("old").alias("src"), F.col("new").alias("_a"))
    b = renames.select(F.col("old").alias("tgt"), F.col("new").alias("_b"))
    e = edges.join(a, "src", "left").join(b, "tgt", "left").withColumn("x", F.coalesce("_a", "src")).withColumn("y", F.coalesce("_b", "tgt"))
    return e.where("x <> y").groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("tgt")).agg(F.sum("weight").alias("weight"))


def delete_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges left when nodes go."""
    n = nodes.select("node").distinct()
    return edges.join(n, F.col("src") == F.col("node"), "left_anti").join(n, F.col("tgt") == F.col("node"), "left_anti")


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): every edge runs from its end of smaller degree, so no node's fan-out exceeds the root of twice the edges."""
    deg = degrees(edges)
    e = edges.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node").alias("tgt"), F.col("degree").alias("dt")), "tgt")
    up = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("src") < F.col("tgt")))
    d = e.select(F.when(up, F.col("src")).otherwise(F.col("tgt")).alias("u"), F.when(up, F.col("tgt")).otherwise(F.col("src")).alias("v"))
    wedge = d.alias("a").join(d.alias("b"), F.col("a.u") == F.col("b.u")).where(F.col("a.v") < F.col("b.v")).select(F.col("a.u").alias("u"), F.col("a.v").alias("v"), F.col("b.v").alias("w"))
    closed = wedge.join(edges.select(F.col("src").alias("v"), F.col("tgt").alias("w")), ["v", "w"], "left_semi")
    return closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient)."""
    j = degrees(edges).join(triangles(edges), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return j.withColumn("coefficient", F.round(F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(0.0), 6))


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component): labels spread to neighbours and jump to their label's label until none moves."""
    adj = stored(adjacency(edges).select("node", "nbr"), "adjacency")
    lab = stored(adj.groupBy("node").agg(F.min("nbr").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(most):
        near = adj.join(lab.select(F.col("node").alias("nbr"), F.col("component").alias("c")), "nbr").groupBy("node").agg(F.min("c").alias("c"))
        low = lab.join(near, "node").select("node", "component", F.least("component", "c").alias("low"))
        jump = low.alias("a").join(low.select(F.col("node").alias("n2"), F.col("low").alias("far")), F.col("low") == F.col("n2"), "left")
        new = stored(jump.select("node", F.col("component").alias("old"), F.least("low", F.coalesce("far", "low")).alias("component")), "labels")
        spent(lab)
        settled = new.where("old <> component").isEmpty()
        lab = new.select("node", "component")
        if settled:
            spent(adj)
            return lab
        lab._stored_at = new._stored_at
    raise RuntimeError("components did not settle")


def truncation(found: DataFrame, most: int) -> DataFrame:
    """One row (nodes, is_truncated): what a view of at most ``most`` of the found nodes shows, and whether that cap cut it. Depth alone cuts nothing."""
    n = F.count(F.lit(1))
    return found.agg(F.least(n, F.lit(most)).cast("long").alias("nodes"), (n > most).alias("is_truncated"))


def labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(label) of every node, once, in order."""
    n = edges.select(F.explode(F.array("src", "tgt")).alias("label"))
    return (n if nodes is None else n.unionByName(nodes.select(F.col("name").alias("label")))).distinct().orderBy("label")


def transitivity(edges: DataFrame) -> DataFrame:
    """One row (transitivity): closed over all pairs of neighbours."""
    c = clustering(edges)
    pairs = F.sum(F.col("degree") * (F.col("degree") - 1) / 2)
    return c.agg(F.round(F.when(pairs > 0, F.sum("triangles") / pairs).otherwise(F.lit(0.0)), 6).alias("transitivity"))


def clustering_by(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, n, mean, median) of the clustering coefficients by ``kinds(node, kind)``."""
    j = clustering(edges).join(kinds, "node")
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coefficient"), 6).alias("mean"), F.round(F.percentile("coefficient", 0.5), 6).alias("median"))


def degree_counts(edges: DataFrame, cuts: tuple[int, ...] = (100, 50)) -> DataFrame:
    """One row: nodes, the greatest degree, and how many nodes reach each cut."""
    d = degrees(edges)
    return d.agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("greatest"), *[F.count_if(F.col("degree") >= c).alias(f"from_{c}") for c in cuts])


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community): each node takes the label of greatest weight among its neighbours, its own counting once, ties to the smaller; all at once, until none moves or the rounds end."""
    adj = adjacency(edges)
    lab = stored(adj.select("node").distinct().withColumn("community", F.col("node")), "communities")
    for _ in range(rounds):
        votes = adj.join(lab.select(F.col("node").alias("nbr"), "community"), "nbr").select("node", "community", "weight").unionByName(lab.withColumn("weight", F.lit(1.0)))
        best = votes.groupBy("node", "community").agg(F.sum("weight").alias("w")).groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community"))["community"].alias("community"))
        new = stored(best, "communities")
        same = new.join(lab, ["node", "community"], "left_anti").isEmpty()
        spent(lab)
        lab = new
        if same:
            break
    return lab


def min_max_size(deg: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Degrees scaled to sizes for drawing; the extremes are one row."""
    ends = deg.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return deg.join(F.broadcast(ends), how="cross").select("node", "degree", F.round(F.when(span > 0, low + (high - low) * (F.col("degree") - F.col("lo")) / span).otherwise(F.lit(low)), 6).alias("size"))


def top_per(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
