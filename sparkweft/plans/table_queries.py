"""Tables and indexes that change by deltas, and tables of questions, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import hash_id, relation_id, words
from sparkweft.operators import edits as E
from sparkweft.operators import hooks as H
from sparkweft.operators import labels as A
from sparkweft.operators import lexical as L
from sparkweft.operators import many as M
from sparkweft.operators import tripartite as T
from sparkweft.operators.louvain import louvain
from sparkweft.operators.segments import Found, SegmentedIndex
from sparkweft.plans import data as D
from sparkweft.plans import graph_queries as Q
from sparkweft.plans import retrieval_queries as R
from sparkweft.sources.keyed import KeyedTable
from sparkweft.sources.store import kept, scratch, spread


def upsert_history(spark: SparkSession, sf: str) -> DataFrame:
    """Customers after their greatest orders were written over their balances, a nation was deleted, some of it came back, and grown buckets were merged."""
    c, o = D.table(spark, sf, "customer"), D.table(spark, sf, "orders")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.lit(0).alias("made"))
    table = KeyedTable.create(spark, scratch(spark, "customers"), base, ["id"], buckets=8, first=("made",), fill=True)
    table.upsert(o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("amount")).withColumn("made", F.lit(1)))
    table.delete(c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")))
    table.compact()
    table.upsert(c.where("c_nationkey = 3 and c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("back "), "c_name").alias("name"), F.lit(2).alias("made")))
    return table.read()


def _segments(spark: SparkSession, sf: str) -> SegmentedIndex:
    """The chunks in two loads, English ones first; then those of toxic documents are deleted."""
    docs = D.table(spark, sf, "documents")

    def make(path: str) -> None:
        chunks = spread(docs).select(F.col("doc_id").alias("id"), words("text").alias("terms"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english"))
        ix = SegmentedIndex.create(spark, path, chunks.where("english").drop("english"))
        ix.add(chunks.where("not english").drop("english"))
        ix.delete(D.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))

    return kept(spark, "segments", [docs, D.table(spark, sf, "labels")], make, lambda path: SegmentedIndex(spark, path))


def _blocks(spark: SparkSession, sf: str) -> Found:
    return _segments(spark, sf).top_k(R._question(spark, sf), 20)


def bm25_segments(spark: SparkSession, sf: str) -> DataFrame:
    """All postings of the question's words, out of every segment."""
    return L.top_k(_segments(spark, sf).view(), R._question(spark, sf), 20)


def bm25_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same, from the blocks that can hold the best."""
    return _blocks(spark, sf).rows


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each label: its first vector."""
    v = D.vectors(spark, sf)
    return v.groupBy(F.col("bucket").alias("qid")).agg(F.min_by("v", "id").alias("q"))


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_many(D.vectors(spark, sf).select("id", "name", "v"), _questions(spark, sf), 10).select("qid", "pos", F.col("name").alias("node"), "score")


def beam_many(spark: SparkSession, sf: str) -> DataFrame:
    anchors = _starts(spark, sf).withColumn("score", F.lit(1.0))
    return M.beam_many(D.adjacency(spark, sf), D.vectors(spark, sf), _questions(spark, sf), anchors, hops=2, width=4, threshold=0.05, top_k=20)


def focused_many(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    rel = Q._relation_ids(spark, sf).join(v.select("id", "v"), "id")
    return M.focused_many(_starts(spark, sf), rel, _questions(spark, sf), 0.6, 0.4, 0.1, 5, 30)


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, c): customers, the parts they bought and the suppliers these came from."""
    li, o = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"))


def rename_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the smallest size take their brand's name, which several share, and are merged: nodes, edges and the ids of vectors after it."""
    p = D.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_type").alias("kind"), "p_size", "p_brand")
    renames = p.where("p_size = 1").select(F.col("name").alias("old"), F.col("p_brand").alias("new"))
    vectors = D.vectors(spark, sf).select(hash_id("ent-", "name").alias("id"), F.col("id").alias("v"))
    vectors = vectors.unionByName(D.edges(spark, sf).select(relation_id("src", "tgt").alias("id"), F.lit(-1).cast("long").alias("v")))
    nodes, edges, moved = E.rename_entities(p.select("name", "kind"), D.edges(spark, sf).select("src", "tgt", "weight"), vectors, renames, merge=True)
    out = nodes.select(F.lit("node").alias("what"), "name", F.col("kind").alias("told"))
    out = out.unionByName(edges.select(F.lit("edge").alias("what"), F.concat_ws("-", "src", "tgt").alias("name"), F.col("weight").cast("long").cast("string").alias("told")))
    return out.unionByName(moved.select(F.lit("vector").alias("what"), F.col("id").alias("name"), F.col("v").cast("string").alias("told")))


#: What the reranked documents are asked for; a window's score is the share of its words that stand in it.
_ASKED = "the of and in die der und de la les"


def rerank_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 documents with the best window, out of all windows of all documents."""

    def share(question: str, windows: list[str]) -> list[float]:
        known = set(question.split())
        return [sum(w in known for w in t.split(" ")) / len(t.split(" ")) for t in windows]

    chunks = D._chunks(spread(D.table(spark, sf, "documents"))).select("id", "terms")
    return H.rerank_documents(chunks, _ASKED, H.reranker(share), 48, 8, "max", 25)


def search_labels_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The label search of ``search_labels`` out of the gram index of part names, made once of each state of the parts."""
    part = D.table(spark, sf, "part")
    buckets = 32
    ix = kept(spark, "labels", [part], lambda path: A.index(part.select(F.col("p_name").alias("node")), path, buckets), lambda path: A.Labels(path, buckets))
    return A.search(spark, ix, Q.SEARCH, 50).rows


def clustering_trade(spark: SparkSession, sf: str) -> DataFrame:
    """Degree, triangles and clustering coefficient of every customer, part and supplier."""
    told = T.clustering(_trade(spark, sf), D.table(spark, sf, "lineitem").count())
    return told.select(F.concat(F.element_at(F.array(F.lit("C"), F.lit("P"), F.lit("S")), F.col("kind") + 1), "key").alias("node"), "degree", "triangles", "coefficient")


def communities(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by what they trade with each other."""
    return louvain(D.nation_edges(spark, sf))


QUERIES = {f.__name__: f for f in (upsert_history, bm25_segments, bm25_blocks, beam_many, focused_many, rename_with_vectors, rerank_documents, search_labels_indexed, clustering_trade, communities)}

_LEX = f"ch AS (SELECT doc_id AS id, {D.TERMS} AS terms FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {R._ASK}, {R._bm25('ch', 'ask', 20)}"
_MANY = f"""{D.VECTORS}, qs AS (SELECT bucket AS qid, arg_min(v, id) AS q FROM vec GROUP BY 1),
sc AS (SELECT qid, id, name, round(list_cosine_similarity(v, q), 6) AS score FROM vec, qs),
an AS (SELECT qid, name AS node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS pos FROM sc QUALIFY pos <= 10)"""


def _hop(n: int, depth: str, start: str, seen: str, wide: int) -> str:
    """One hop of all walks out of ``start(qid, node, score)``: the steps k<n> and the nodes f<n> that they reach."""
    return f"""c{n} AS (SELECT s.qid, nbr, s.node AS parent, coalesce(sc.score, 0) AS sem, round(0.6 * coalesce(sc.score, 0) + 0.2 * s.score + 0.1 * least(weight / 10, 1) - 0.1 * ln({depth}), 6) AS score
  FROM {start} s JOIN adj ON adj.node = s.node LEFT JOIN sc ON sc.name = nbr AND sc.qid = s.qid WHERE (s.qid, nbr) NOT IN (SELECT (qid, node) FROM {seen})),
k{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, nbr, parent) AS place FROM c{n} WHERE score >= 0.05) JOIN (SELECT qid, {wide} * count(*) AS quota FROM {start} GROUP BY 1) USING (qid) WHERE place <= quota),
f{n} AS (SELECT qid, nbr AS node, score, parent FROM k{n} QUALIFY row_number() OVER (PARTITION BY qid, nbr ORDER BY score DESC, parent) = 1)"""


ORACLE_SQL = {
    "bm25_segments": f"WITH {_LEX} SELECT id, score FROM lex",
    "bm25_blocks": f"WITH {_LEX} SELECT id, score FROM lex",
    "rerank_documents": f"""WITH {D.CHUNKS}, w AS (SELECT id, terms[i * 40 + 1 : i * 40 + 48] AS t FROM (SELECT *, unnest(range(0, greatest(1, ceil((len(terms) - 8) / 40))::BIGINT)) AS i FROM chunks WHERE len(terms) > 0)),
s AS (SELECT id AS doc, round(max(len(list_filter(t, lambda x: list_contains(string_split('{_ASKED}', ' '), x))) / len(t)), 6) AS score FROM w GROUP BY 1)
SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS pos FROM s QUALIFY pos <= 25""",
    "rename_with_vectors": f"""WITH {D.EDGES}, {D.VECTORS}, ren AS (SELECT 'P' || p_partkey AS old, p_brand AS new FROM part WHERE p_size = 1),
n AS (SELECT coalesce(new, 'P' || p_partkey) AS name, coalesce(old, '') AS f, p_type AS kind FROM part LEFT JOIN ren ON old = 'P' || p_partkey),
e AS (SELECT src, tgt, weight, coalesce(a.new, src) AS x, coalesce(b.new, tgt) AS y FROM edges LEFT JOIN ren a ON a.old = src LEFT JOIN ren b ON b.old = tgt),
v AS (SELECT 'ent-' || md5(coalesce(new, name)) AS to_id, new IS NOT NULL AS m, 'ent-' || md5(name) AS id, vec.id AS v FROM vec LEFT JOIN ren ON old = name
  UNION ALL SELECT 'rel-' || md5(least(x, y) || greatest(x, y)), x <> src OR y <> tgt, 'rel-' || md5(least(src, tgt) || greatest(src, tgt)), -1 FROM e WHERE x <> y)
SELECT 'node' AS what, name, arg_min(kind, f) AS told FROM n GROUP BY name
UNION ALL SELECT 'edge', least(x, y) || '-' || greatest(x, y), sum(weight)::BIGINT::VARCHAR FROM e WHERE x <> y GROUP BY 2
UNION ALL SELECT 'vector', to_id, arg_min(v, (m, id))::VARCHAR FROM v GROUP BY to_id""",
    "search_labels_indexed": Q.ORACLE_SQL["search_labels"],
    "clustering_trade": """WITH t AS MATERIALIZED (SELECT DISTINCT o_custkey AS c, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cp AS MATERIALIZED (SELECT DISTINCT c, p FROM t), cs AS MATERIALIZED (SELECT DISTINCT c, s FROM t), ps AS MATERIALIZED (SELECT DISTINCT p, s FROM t),
tri AS MATERIALIZED (SELECT cp.c, cp.p, ps.s FROM cp JOIN ps ON ps.p = cp.p JOIN cs ON cs.c = cp.c AND cs.s = ps.s),
deg AS (SELECT node, count(*) AS degree FROM (SELECT 'C' || c AS node FROM cp UNION ALL SELECT 'P' || p FROM cp UNION ALL SELECT 'C' || c FROM cs UNION ALL SELECT 'S' || s FROM cs UNION ALL SELECT 'P' || p FROM ps UNION ALL SELECT 'S' || s FROM ps) GROUP BY 1),
n AS (SELECT node, count(*) AS triangles FROM (SELECT 'C' || c AS node FROM tri UNION ALL SELECT 'P' || p FROM tri UNION ALL SELECT 'S' || s FROM tri) GROUP BY 1)
SELECT node, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN round(2 * coalesce(triangles, 0) / (degree * (degree - 1)), 6) ELSE 0.0 END AS coefficient FROM deg LEFT JOIN n USING (node)""",
    "beam_many": f"""WITH {D.EDGES}, {D.ADJ}, {_MANY}, a AS (SELECT qid, node, 1.0::DOUBLE AS score FROM an),
{_hop(1, "2", "a", "a", 4)}, on1 AS (SELECT * FROM f1 WHERE qid NOT IN (SELECT qid FROM k1 WHERE place <= 3 AND sem >= 0.8)), seen AS (SELECT qid, node FROM a UNION ALL SELECT qid, node FROM f1),
{_hop(2, "3", "on1", "seen", 2)}
SELECT qid, node, score, hop, parent FROM (SELECT qid, node, score, 0::BIGINT AS hop, NULL AS parent FROM a UNION ALL SELECT qid, node, score, 1, parent FROM f1 UNION ALL SELECT qid, node, score, 2, parent FROM f2)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, hop, node) <= 80""",
    "focused_many": f"""WITH {D.EDGES}, {_MANY}, {R._REL},
jo AS (SELECT an.qid, src, tgt, weight, round(list_cosine_similarity(v, q), 6) AS sim, node AS anchor, pos, an.score FROM rel JOIN an ON node = src OR node = tgt JOIN qs ON qs.qid = an.qid),
jj AS (SELECT *, round(0.6 * score + 0.4 * sim, 6) AS joint FROM jo WHERE sim >= 0.1),
qu AS (SELECT * FROM jj QUALIFY row_number() OVER (PARTITION BY qid, pos ORDER BY joint DESC, src, tgt) <= 5),
un AS (SELECT * FROM qu QUALIFY row_number() OVER (PARTITION BY qid, src, tgt ORDER BY pos) = 1)
SELECT qid, src, tgt, weight, sim, anchor, joint FROM un QUALIFY row_number() OVER (PARTITION BY qid ORDER BY joint DESC, src, tgt) <= 30""",
    "upsert_history": """
WITH o AS (SELECT o_custkey AS id, max(o_totalprice) AS amount FROM orders GROUP BY 1),
c AS (SELECT coalesce(c_custkey, id) AS id, c_name AS name, coalesce(o.amount, c_acctbal) AS amount, CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END AS made, c_nationkey, c_acctbal FROM customer FULL JOIN o ON o.id = c_custkey)
SELECT id, name, amount, made FROM c WHERE c_nationkey IS DISTINCT FROM 3
UNION ALL SELECT c_custkey, 'back ' || c_name, NULL, 2 FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0
""",
}
