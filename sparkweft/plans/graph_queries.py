"""Vector and graph queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.operators import graph as G
from sparkweft.operators import vector as V
from sparkweft.operators.ranking import numbered
from sparkweft.plans import data as D
from sparkweft.sources.store import spent, stored

K = 10


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return V.top_k(D.vectors(spark, sf), D.query_vector(spark, sf), K, 0.2).select("id", "name", "score")


def vector_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 7), (1, 10**9), (2, 3), (3, 7)], "pos long, id long")
    return V.by_ids(D.vectors(spark, sf).select("id", "name", "bucket"), asked).select("pos", "id", "name", "bucket")


def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return V.ivf_top_k(D.ivf(spark, sf), D.query_vector(spark, sf), K, probes=2, most=8).select("id", "bucket", "score")


def ivf_build(spark: SparkSession, sf: str) -> DataFrame:
    """What the inverted file holds: each bucket's size and its centroid's first and last numbers and length."""
    c = D.ivf(spark, sf).centroids
    return c.select("bucket", "n", F.round(F.col("c")[0], 6).alias("first"), F.round(F.element_at("c", -1), 6).alias("last"), F.round(F.sqrt(V.dot(F.col("c"), F.col("c"))), 6).alias("length"))


def ivf_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted file, searched whole while it has fewer than 1,000 vectors."""
    return V.ivf_top_k(D.ivf(spark, sf), D.query_vector(spark, sf), K, probes=2, most=8, fewest=V.FEWEST).select("id", "bucket", "score")


def node_degree(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    return G.node_degrees(D.edges(spark, sf), parts)


def edge_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return G.with_edge_degree(e, G.degrees(e)).select("src", "tgt", "weight", "edge_degree")


def _seeds(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return V.ranked(V.top_k(D.vectors(spark, sf), D.query_vector(spark, sf), k), F.desc("score"), "id").select(F.col("name").alias("node"), "pos", "score")


def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges_of(D.edges(spark, sf), _seeds(spark, sf)).select("src", "tgt", "weight")


def edges_batch(spark: SparkSession, sf: str) -> DataFrame:
    ask = D.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b")).distinct()
    return G.edges_batch(D.edges(spark, sf), ask).select("a", "b", "weight")


def popular_labels(spark: SparkSession, sf: str) -> DataFrame:
    return G.popular(D.edges(spark, sf), 40)


def search_labels(spark: SparkSession, sf: str) -> DataFrame:
    nodes = D.table(spark, sf, "part").select(F.col("p_name").alias("node")).distinct()
    return G.search_labels(nodes, SEARCH, 50)


SEARCH = "ring"


def bfs_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    start = spark.createDataFrame([("P1",)], "node string")
    return G.bfs(D.edges(spark, sf), start, 3)


def bfs_capped(spark: SparkSession, sf: str) -> DataFrame:
    start = spark.createDataFrame([("P1",)], "node string")
    return G.bfs(D.edges(spark, sf), start, 3, 25)


def bfs_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return G.edges_between(e, G.bfs(e, spark.createDataFrame([("P1",)], "node string"), 2)).select("src", "tgt", "weight")


def top_degree_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return G.edges_between(e, G.popular(e, 150)).select("src", "tgt", "weight")


def export_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.adjacency(D.edges(spark, sf)).select("node", "nbr", "weight")


def _renames(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("old"), F.concat(F.lit("S"), F.col("s_suppkey") - 1).alias("new"))


def rename_entity(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.createDataFrame([("S1", "Z1")], "old string, new string")
    return G.rename(D.edges(spark, sf), one)


def merge_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.rename(D.edges(spark, sf), _renames(spark, sf))


def delete_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.delete_nodes(D.edges(spark, sf), _renames(spark, sf).select(F.col("old").alias("node"))).select("src", "tgt", "weight")


def degree_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return G.min_max_size(G.degrees(D.edges(spark, sf)))


def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return G.clustering(D.nation_edges(spark, sf)).select("node", "degree", "triangles", "coefficient")


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Of all edges. SQL would take each pair of a component; the test compares with a union-find."""
    return G.components(D.edges(spark, sf))


def degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = G.degrees(D.edges(spark, sf))
    n = F.count(F.lit(1))
    return d.agg(n.alias("nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.round(F.percentile("degree", 0.5), 6).alias("median_degree"), (F.sum("degree") / 2).cast("long").alias("edges"), F.round(F.sum("degree") / (n * (n - 1)), 9).alias("density"), F.count_if(F.col("degree") >= 50).alias("hubs"))


def local_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest entities, then all their edges by the sum of degrees and weight."""
    return _local(spark, sf, _seeds(spark, sf))


def _local(spark: SparkSession, sf: str, seeds: DataFrame) -> DataFrame:
    hit = G.with_edge_degree(G.edges_of(D.edges(spark, sf), seeds), D.degrees(spark, sf))
    return numbered(hit.select("src", "tgt", "weight", "edge_degree"), F.desc("edge_degree"), F.desc("weight"), "src", "tgt")


def _relation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(src, tgt, weight, score): each edge has the vector of a number made of its ends; vectors are compared once, whatever shares them."""
    v = V.scored(D.vectors(spark, sf).select("id", "v"), D.query_vector(spark, sf)).select("id", "score")
    return _relation_ids(spark, sf).join(v, "id").select("src", "tgt", "weight", "score")


def _relation_ids(spark: SparkSession, sf: str) -> DataFrame:
    """(id, src, tgt, weight): each edge and the number of its vector."""
    n = D.vectors(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    e = D.edges(spark, sf).join(F.broadcast(n), how="cross").withColumn("id", (F.substring("src", 2, 20).cast("long") * 31 + F.substring("tgt", 2, 20).cast("long")) % F.col("n"))
    return e.select("id", "src", "tgt", "weight")


#: So many vectors are looked at first for the best relations.
NEAR = 1000


def _best_relations(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The best k relations and their places, stored.

    A relation's score is that of its vector, so those of the nearest vectors
    are the best, if there are k of them above the last of these; edges need
    not move then. Otherwise every edge is joined with its vector.
    """
    v = V.scored(D.vectors(spark, sf).select("id", "v"), D.query_vector(spark, sf)).select("id", "score")
    near = stored(v.orderBy(F.desc("score"), "id").limit(NEAR), "near")

    def best(scores: DataFrame) -> DataFrame:
        few = _relation_ids(spark, sf).join(scores, "id").select("src", "tgt", "weight", "score").orderBy(F.desc("score"), "src", "tgt").limit(k)
        return stored(V.ranked(few, F.desc("score"), "src", "tgt"), "relations")

    out = best(F.broadcast(near))
    n, last = near.agg(F.count(F.lit(1)), F.min("score")).first()
    # The last of the nearest may share its score with vectors left out.
    if n == NEAR and out.where(F.col("score") > (float("nan") if last is None else last)).count() < k:
        spent(out)
        out = best(v)
    spent(near)
    return out


def global_search(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest relations, then their ends in order of first appearance."""
    return _ends(_best_relations(spark, sf, 15))


def _ends(best: DataFrame) -> DataFrame:
    r = best.select("pos", F.posexplode(F.array("src", "tgt")).alias("side", "node"))
    first = r.groupBy("node").agg(F.min(2 * F.col("pos") + F.col("side")).alias("at"))
    return V.ranked(first, "at").select("pos", "node")


def relation_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _best_relations(spark, sf, 15).select("pos", "src", "tgt", "score")


def naive_search(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks alone: the documents whose vectors are nearest."""
    best = V.top_k(D.vectors(spark, sf), D.query_vector(spark, sf, 3), K, 0.2)
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"))
    return V.ranked(best.join(docs, "id"), F.desc("score"), "id").select("pos", "id", "file_path", "score")


_TOP = f"""{D.VECTORS}, {D.QUERY},
sc AS (SELECT id, name, bucket, v, round(list_cosine_similarity(v, q), 6) AS score FROM vec, qv),
seeds AS (SELECT name AS node, row_number() OVER (ORDER BY score DESC, id) AS pos, score FROM sc ORDER BY score DESC, id LIMIT 10)"""
_HOP = "hop AS (SELECT e.* FROM edges e WHERE src IN (SELECT node FROM seeds) OR tgt IN (SELECT node FROM seeds))"
_REN = "ren AS (SELECT 'S' || s_suppkey AS old, 'S' || (s_suppkey - 1) AS new FROM supplier WHERE s_suppkey % 3 = 0)"
_MERGED = """x AS (SELECT coalesce(a.new, src) AS x, coalesce(b.new, tgt) AS y, weight FROM edges LEFT JOIN ren a ON a.old = src LEFT JOIN ren b ON b.old = tgt)
SELECT least(x, y) AS src, greatest(x, y) AS tgt, sum(weight) AS weight FROM x WHERE x <> y GROUP BY 1, 2"""
_BFS = "r(node, level) AS (SELECT 'P1', 0::BIGINT UNION SELECT adj.nbr, r.level + 1 FROM r JOIN adj ON adj.node = r.node WHERE r.level < {0}), lev AS (SELECT node, min(level) AS level FROM r GROUP BY 1)"
_REL = """rel AS (SELECT src, tgt, weight, v FROM edges JOIN vec ON vec.id = (substr(src, 2)::BIGINT * 31 + substr(tgt, 2)::BIGINT) % (SELECT count(*) FROM vec)),
best AS (SELECT row_number() OVER (ORDER BY score DESC, src, tgt) AS pos, src, tgt, score FROM (SELECT src, tgt, round(list_cosine_similarity(v, q), 6) AS score FROM rel, qv ORDER BY score DESC, src, tgt LIMIT 15))"""

QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_by_ids, ivf_topk, ivf_build, ivf_exact, node_degree, edge_degree, one_hop, edges_batch, popular_labels, search_labels, bfs_subgraph, bfs_capped, bfs_edges, top_degree_subgraph, export_relations, rename_entity, merge_entities, delete_entities, degree_minmax, clustering, components, degree_stats, local_search, relation_topk, global_search, naive_search)
}

ORACLE_SQL = {
    "vector_topk": f"WITH {_TOP} SELECT id, name, score FROM sc WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 10",
    "vector_by_ids": f"WITH {D.VECTORS}, w(pos, id) AS (VALUES (0, 7), (1, 1000000000), (2, 3), (3, 7)) SELECT w.pos::BIGINT AS pos, w.id::BIGINT AS id, name, bucket FROM w LEFT JOIN vec ON vec.id = w.id",
    "ivf_topk": f"""WITH {_TOP},
m AS (SELECT bucket, i, avg(v[i]) AS x FROM vec, range(1, 65) t(i) GROUP BY 1, 2),
c AS (SELECT m.bucket, list(x ORDER BY i) AS c, any_value(n) AS n FROM m JOIN (SELECT bucket, count(*) AS n FROM vec GROUP BY 1) USING (bucket) GROUP BY 1),
nr AS (SELECT bucket, row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS reach FROM (SELECT bucket, n, round(list_cosine_similarity(c, q), 6) AS sim FROM c, qv) WINDOW w AS (ORDER BY sim DESC, bucket)),
p AS (SELECT CASE WHEN max(reach) FILTER (rank <= 2) >= 30 THEN 2 WHEN max(reach) FILTER (rank <= 4) >= 30 THEN 4 ELSE 8 END AS p FROM nr)
SELECT id, bucket, score FROM sc WHERE bucket IN (SELECT bucket FROM nr, p WHERE rank <= p) ORDER BY score DESC, id LIMIT 10""",
    "node_degree": f"WITH {D.EDGES}, {D.ADJ} SELECT 'P' || p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN deg ON node = 'P' || p_partkey",
    "edge_degree": f"WITH {D.EDGES}, {D.ADJ} SELECT src, tgt, weight, a.degree + b.degree AS edge_degree FROM edges JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt",
    "one_hop": f"WITH {D.EDGES}, {_TOP}, {_HOP} SELECT src, tgt, weight FROM hop",
    "edges_batch": f"WITH {D.EDGES}, a AS (SELECT DISTINCT 'S' || l_suppkey AS a, 'P' || l_partkey AS b FROM lineitem) SELECT a, b, weight FROM a JOIN edges ON src = b AND tgt = a",
    "popular_labels": f"WITH {D.EDGES}, {D.ADJ} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 40",
    "search_labels": f"""WITH n AS (SELECT DISTINCT p_name AS node FROM part)
SELECT node, score::BIGINT AS score FROM (SELECT node, CASE WHEN lower(node) = '{SEARCH}' THEN 1000 WHEN starts_with(lower(node), '{SEARCH}') THEN 500
 WHEN contains(lower(node), '{SEARCH}') THEN 100 - length(node) + CASE WHEN contains(' ' || lower(node), ' {SEARCH}') OR contains('_' || lower(node), '_{SEARCH}') THEN 50 ELSE 0 END END AS score FROM n)
WHERE score IS NOT NULL ORDER BY score DESC, node LIMIT 50""",
    "bfs_subgraph": f"WITH RECURSIVE {D.EDGES}, {D.ADJ}, {_BFS.format(3)} SELECT node, level FROM lev",
    "bfs_capped": f"WITH RECURSIVE {D.EDGES}, {D.ADJ}, {_BFS.format(3)} SELECT node, level FROM lev JOIN deg USING (node) ORDER BY level, degree DESC, node LIMIT 25",
    "bfs_edges": f"WITH RECURSIVE {D.EDGES}, {D.ADJ}, {_BFS.format(2)} SELECT src, tgt, weight FROM edges WHERE src IN (SELECT node FROM lev) AND tgt IN (SELECT node FROM lev)",
    "top_degree_subgraph": f"WITH {D.EDGES}, {D.ADJ}, t AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 150) SELECT src, tgt, weight FROM edges WHERE src IN (FROM t) AND tgt IN (FROM t)",
    "export_relations": f"WITH {D.EDGES}, {D.ADJ} SELECT node, nbr, weight FROM adj",
    "rename_entity": f"WITH {D.EDGES}, ren AS (SELECT 'S1' AS old, 'Z1' AS new), {_MERGED}",
    "merge_entities": f"WITH {D.EDGES}, {_REN}, {_MERGED}",
    "delete_entities": f"WITH {D.EDGES}, {_REN} SELECT src, tgt, weight FROM edges WHERE src NOT IN (SELECT old FROM ren) AND tgt NOT IN (SELECT old FROM ren)",
    "degree_minmax": f"WITH {D.EDGES}, {D.ADJ}, m AS (SELECT min(degree) AS lo, max(degree) AS hi FROM deg) SELECT node, degree, round(CASE WHEN hi > lo THEN 0.5 + 1.5 * (degree - lo) / (hi - lo) ELSE 0.5 END, 6) AS size FROM deg, m",
    "clustering": f"""WITH {D.NATIONS}, {D.ADJ},
t AS (SELECT a.node, count(*) AS n FROM adj a JOIN adj b ON a.node = b.node AND a.nbr < b.nbr JOIN edges e ON e.src = a.nbr AND e.tgt = b.nbr GROUP BY 1)
SELECT deg.node, degree, coalesce(n, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM deg LEFT JOIN t USING (node)""",
    "degree_stats": f"WITH {D.EDGES}, {D.ADJ} SELECT count(*) AS nodes, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, round(quantile_cont(degree, 0.5), 6)::DOUBLE AS median_degree, (sum(degree) / 2)::BIGINT AS edges, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density, count(*) FILTER (degree >= 50) AS hubs FROM deg",
    "local_search": f"WITH {D.EDGES}, {D.ADJ}, {_TOP}, {_HOP} SELECT row_number() OVER (ORDER BY a.degree + b.degree DESC, weight DESC, src, tgt) AS pos, src, tgt, weight, a.degree + b.degree AS edge_degree FROM hop JOIN deg a ON a.node = src JOIN deg b ON b.node = tgt",
    "relation_topk": f"WITH {D.EDGES}, {D.VECTORS}, {D.QUERY}, {_REL} SELECT pos, src, tgt, score FROM best",
    "global_search": f"WITH {D.EDGES}, {D.VECTORS}, {D.QUERY}, {_REL}, f AS (SELECT node, min(o) AS o FROM (SELECT src AS node, 2 * pos AS o FROM best UNION ALL SELECT tgt, 2 * pos + 1 FROM best) GROUP BY 1) SELECT row_number() OVER (ORDER BY o) AS pos, node FROM f",
    "naive_search": f"WITH {D.VECTORS}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), t AS (SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM vec, qv WHERE round(list_cosine_similarity(v, q), 6) >= 0.2 ORDER BY score DESC, id LIMIT 10) SELECT row_number() OVER (ORDER BY score DESC, id) AS pos, id, source AS file_path, score FROM t JOIN documents ON doc_id = id",
}
_PROBED = ORACLE_SQL["ivf_topk"]
ORACLE_SQL["ivf_exact"] = _PROBED.replace("WHERE bucket IN", "WHERE (SELECT count(*) FROM vec) < 1000 OR bucket IN")
ORACLE_SQL["ivf_build"] = _PROBED.split(",\nnr AS")[0] + " SELECT bucket, n, round(c[1], 6) AS first, round(c[len(c)], 6) AS last, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS length FROM c"
