"""Lookups, scalar functions, model hooks and graph figures over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import text as T
from sparkweft.operators import analytics as A
from sparkweft.operators import edits as E
from sparkweft.operators import extract as X
from sparkweft.operators import graph as G
from sparkweft.operators import hooks as H
from sparkweft.operators import tables as K
from sparkweft.operators import vector as V
from sparkweft.plans import data as D
from sparkweft.plans import document_queries as Q


def kv_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return K.delete(D.table(spark, sf, "customer"), gone, "c_custkey").select("c_custkey", "c_name")


def kv_empty(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer")
    return K.is_empty(c).withColumn("state", F.lit("full")).unionByName(K.is_empty(K.cleared(c)).withColumn("state", F.lit("cleared")))


def cache_delete_class(spark: SparkSession, sf: str) -> DataFrame:
    return K.delete_class(Q.cache_flatten(spark, sf), "m1", "user")


def cache_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of one prefix under a new one."""
    return K.by_prefix(Q.cache_flatten(spark, sf), "m2:extract:", "key").select(F.concat(F.lit("default:"), F.substring("key", 4, 100)).alias("key"), "return")


def docs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    s = D.statuses(spark, sf).withColumn("track_id", F.concat(F.lit("t"), F.col("content_length") % 5))
    cols = ["doc_id", "status", "file_path"]
    one = K.by_status(s.withColumn("file_path", F.when(F.col("content_length") > 500, F.col("file_path"))), "failed", "processing").select(F.lit("status").alias("way"), *cols)
    two = K.by_track(s, "t3").select(F.lit("track").alias("way"), *cols)
    return one.unionByName(two).unionByName(K.first_by_path(s, "src3").select(F.lit("path").alias("way"), *cols))


def docs_shown_status(spark: SparkSession, sf: str) -> DataFrame:
    s = D.statuses(spark, sf)
    return s.select("doc_id", K.shown_status(F.col("status"), F.col("content_length") % 2 == 0).alias("status"))


def error_documents(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.concat(F.lit("f"), "event_id").alias("path"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return E.error_documents(e, F.lit(0).cast("long"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").where("p_size > 25").select((F.col("p_partkey") - 1).alias("id"), F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_name").alias("content"))
    out = V.upsert_vectors(D.vectors(spark, sf), p, lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)))
    return out.select("id", "name", F.size("v").cast("long").alias("dims"), F.round(F.col("v")[0], 6).alias("first"), "bucket")


def vector_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = D.table(spark, sf, "part").where("p_size > 25").select((F.col("p_partkey") - 1).alias("id"))
    return V.delete_vectors(D.vectors(spark, sf), gone).select("id", "name")


def vector_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_dimension(D.vectors(spark, sf), 64).agg(F.count(F.lit(1)).alias("n"))


def relations_without(spark: SparkSession, sf: str) -> DataFrame:
    return V.without_entity(D.edges(spark, sf), "S1").select("src", "tgt")


def all_labels(spark: SparkSession, sf: str) -> DataFrame:
    return G.labels(D.edges(spark, sf), D.table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("name")))


def bfs_truncated(spark: SparkSession, sf: str) -> DataFrame:
    found = G.bfs(D.edges(spark, sf), spark.createDataFrame([("P1",)], "node string"), 2)
    return G.truncation(found, 10).withColumn("most", F.lit(10)).unionByName(G.truncation(found, 1_000_000).withColumn("most", F.lit(1_000_000)))


def transitivity(spark: SparkSession, sf: str) -> DataFrame:
    return G.transitivity(D.nation_edges(spark, sf))


def clustering_types(spark: SparkSession, sf: str) -> DataFrame:
    kinds = D.table(spark, sf, "nation").join(D.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.col("r_name").alias("kind"))
    return G.clustering_by(D.nation_edges(spark, sf), kinds)


def degree_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.degree_counts(D.edges(spark, sf))


def keyword_acquisition(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords given, cached or asked for; a short question without any is its own."""
    c = D.table(spark, sf, "conversations")
    k = F.col("conv_id") * 1000 + F.col("turn")
    none = F.array().cast("array<string>")
    ask = c.select(k.alias("id"), F.col("text").alias("question"), F.when(k % 5 == 0, F.array(F.lit("given"))).otherwise(none).alias("hl"), none.alias("ll"))
    told = F.concat(F.lit('<think>hm</think> sure:\n```json\n{"high_level_keywords": ["h'), k, F.lit('", "x",], "low_level_keywords": ["l'), k, F.lit('"],}\n```'))
    cache = c.where(k % 5 < 3).select(k.alias("id"), F.when(k % 5 == 2, F.lit("no idea")).otherwise(told).alias("answer"))
    out = X.query_keywords(ask, cache, lambda q: F.when(F.length(q) % 2 == 0, F.lit('{"low_level_keywords": ["asked"]}')))
    return out.select("id", "how", F.array_join("hl", ",").alias("hl"), F.array_join("ll", ",").alias("ll"))


def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("role").alias("prompt"), "turn")
    return H.cached(c, c.where("turn % 2 = 0").select("key", F.concat(F.lit("old "), "prompt").alias("return")), F.upper)


def rerank_hook(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("q"), "text")
    score = H.reranker(lambda q, docs: [float(len(d) % 7 + len(q)) for d in docs])
    return c.select("conv_id", "turn", score("q", "text").alias("score"))


def damaged_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of damage to a field mark, put right."""
    marks = F.array(*[F.lit(m) for m in MARKS])
    c = D.table(spark, sf, "customer").withColumn("mark", F.element_at(marks, (F.col("c_custkey") % len(MARKS) + 1).cast("int")))
    return c.select("c_custkey", X.repaired(F.concat_ws("", F.lit("entity"), "mark", "c_name")).alias("record"))


#: Damaged forms of the mark, one or more for each kind of damage.
MARKS = ("<|#|>", "<|##|>", "<|#||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "<|#|>|", "||#||")


def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar functions on made-up text around each part's name."""
    p = D.table(spark, sf, "part")
    name = F.col("p_name")
    esc = F.concat(F.lit('a\\u00e9"\\n\\x '), name)
    html = F.concat(F.lit("&lt;&eacute;&#8364;&copy &amp;amp; "), name)
    q = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/localcontext "), name)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/mix "), name)).otherwise(name)
    mode = T.mode_prefix(q)
    return p.select(
        "p_partkey", T.clean(F.concat(F.lit(" \x01&lt;"), name, F.lit("&gt;\x7f "))).alias("clean"), T.unescaped(html).alias("unescaped"), T.escapes_decoded(esc).alias("decoded"),
        T.created_text(F.col("p_partkey") * 86_461).alias("created"), T.answer_only(F.concat(name, F.lit(" \n### References\n[1]"))).alias("answer"), T.workspace_suffix(F.concat(F.lit("A b-"), name)).alias("suffix"),
        F.array_join(T.split_marks(F.concat(name, F.lit("<|#|>x##y <|#|>")), ["<|#|>", "##"]), "|").alias("split"), T.without_thoughts(F.concat(F.lit("<think>a</think> "), name)).alias("said"),
        X.judge_json(F.concat(F.lit('so ```json\n{"n": "'), name, F.lit('",}\n```'))).alias("json"), mode["mode"].alias("mode"), mode["only_context"].alias("only_context"), mode["question"].alias("question"),
    )


def answer_rates(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    return c.agg(A.rate(F.col("role") == "user").alias("users"), A.rate(F.length("text") > 200).alias("long"), A.rate(F.col("text").startswith("T")).alias("headed"))


QUERIES = {
    f.__name__: f
    for f in (kv_delete, kv_empty, cache_delete_class, cache_migration, docs_by_status, docs_shown_status, error_documents, vector_upsert, vector_delete, vector_dimension, relations_without, all_labels, bfs_truncated, transitivity, clustering_types, degree_counts, keyword_acquisition, cached_answers, rerank_hook, damaged_marks, scalar_text, answer_rates)
}

_FLAT = "f AS (SELECT 'm' || (conv_id % 4) AS mode, CASE WHEN turn % 3 > 0 THEN role ELSE 'extract' END AS kind, conv_id || '-' || turn AS hash, length(text)::BIGINT AS return FROM conversations)"
_CLUSTER = f"""{D.NATIONS}, {D.ADJ}, t AS (SELECT a.node, count(*) AS n FROM adj a JOIN adj b ON a.node = b.node AND a.nbr < b.nbr JOIN edges e ON e.src = a.nbr AND e.tgt = b.nbr GROUP BY 1),
cl AS (SELECT deg.node, degree, coalesce(n, 0) AS n, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM deg LEFT JOIN t USING (node))"""
_GOOD = "'<|#|>'"

ORACLE_SQL = {
    "kv_delete": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "kv_empty": "SELECT NOT EXISTS (SELECT 1 FROM customer) AS is_empty, 'full' AS state UNION ALL SELECT true, 'cleared'",
    "cache_delete_class": f"WITH {_FLAT} SELECT mode || ':' || kind || ':' || hash AS key, return FROM f WHERE NOT (mode = 'm1' AND kind = 'user')",
    "cache_migration": f"WITH {_FLAT} SELECT 'default:' || kind || ':' || hash AS key, return FROM f WHERE mode = 'm2' AND kind = 'extract'",
    "docs_by_status": f"""WITH {D.STATUSES} SELECT 'status' AS way, doc_id, status, CASE WHEN content_length > 500 THEN file_path ELSE 'no-file-path' END AS file_path FROM st WHERE status IN ('failed', 'processing')
UNION ALL SELECT 'track', doc_id, status, file_path FROM st WHERE content_length % 5 = 3 UNION ALL SELECT * FROM (SELECT 'path', doc_id, status, file_path FROM st WHERE file_path = 'src3' ORDER BY doc_id LIMIT 1)""",
    "docs_shown_status": f"WITH {D.STATUSES} SELECT doc_id, CASE WHEN status = 'processed' AND content_length % 2 <> 0 THEN 'preprocessed' ELSE status END AS status FROM st",
    "error_documents": "SELECT 'error-' || md5('f' || event_id || props) AS id, 'f' || event_id AS file_path, 'failed' AS status, '[File Extraction]' || props AS content_summary, 0::BIGINT AS content_length, props AS error_msg, 0::BIGINT AS created_at FROM events WHERE event_type = 'error' AND props IS NOT NULL",
    "vector_upsert": f"WITH {D.VECTORS}, n AS (SELECT p_partkey - 1 AS id, 'P' || p_partkey AS name, length(p_name)::DOUBLE AS l FROM part WHERE p_size > 25) SELECT id, name, len(v)::BIGINT AS dims, round(v[1], 6) AS first, bucket FROM vec WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, name, 2, l, NULL FROM n",
    "vector_delete": f"WITH {D.VECTORS} SELECT id, name FROM vec WHERE id NOT IN (SELECT p_partkey - 1 FROM part WHERE p_size > 25)",
    "vector_dimension": "SELECT count(*) AS n FROM embeddings",
    "relations_without": f"WITH {D.EDGES} SELECT src, tgt FROM edges WHERE src <> 'S1' AND tgt <> 'S1'",
    "all_labels": f"WITH {D.EDGES} SELECT src AS label FROM edges UNION SELECT tgt FROM edges UNION SELECT 'N' || n_nationkey FROM nation",
    "bfs_truncated": f"WITH RECURSIVE {D.EDGES}, {D.ADJ}, r(node, level) AS (SELECT 'P1', 0 UNION SELECT adj.nbr, r.level + 1 FROM r JOIN adj ON adj.node = r.node WHERE r.level < 2), n AS (SELECT count(DISTINCT node) AS n FROM r), m(most) AS (VALUES (10), (1000000)) SELECT least(n, most) AS nodes, n > most AS is_truncated, most FROM n, m",
    "transitivity": f"WITH {_CLUSTER} SELECT round(CASE WHEN sum(degree * (degree - 1) / 2) > 0 THEN sum(n) / sum(degree * (degree - 1) / 2) ELSE 0 END, 6)::DOUBLE AS transitivity FROM cl",
    "clustering_types": f"WITH {_CLUSTER} SELECT r_name AS kind, count(*) AS n, round(avg(coefficient), 6) AS mean, round(quantile_cont(coefficient, 0.5), 6) AS median FROM cl JOIN nation ON node = 'N' || n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "degree_counts": f"WITH {D.EDGES}, {D.ADJ} SELECT count(*) AS nodes, max(degree) AS greatest, count(*) FILTER (degree >= 100) AS from_100, count(*) FILTER (degree >= 50) AS from_50 FROM deg",
    "keyword_acquisition": """WITH q AS (SELECT conv_id * 1000 + turn AS id, (conv_id * 1000 + turn) % 5 AS m, text AS t FROM conversations),
k AS (SELECT *, CASE WHEN m = 0 THEN 'given' WHEN m < 3 THEN 'cache' ELSE 'model' END AS how, CASE WHEN m = 0 THEN 'given' WHEN m = 1 THEN 'h' || id || ',x' ELSE '' END AS hl, CASE WHEN m = 1 THEN 'l' || id WHEN m > 2 AND length(t) % 2 = 0 THEN 'asked' ELSE '' END AS l FROM q)
SELECT id, how, hl, CASE WHEN hl = '' AND l = '' AND length(t) < 50 THEN t ELSE l END AS ll FROM k""",
    "cached_answers": "SELECT conv_id || '-' || turn AS key, CASE WHEN turn % 2 = 0 THEN 'old ' || role ELSE upper(role) END AS return, turn % 2 <> 0 AS fresh FROM conversations",
    "rerank_hook": "SELECT conv_id, turn, (length(text) % 7 + length(role))::DOUBLE AS score FROM conversations",
    "damaged_marks": f"SELECT c_custkey, 'entity' || {_GOOD} || c_name AS record FROM customer",
    "scalar_text": """SELECT p_partkey, '<' || p_name || '>' AS clean, '<' || chr(233) || chr(8364) || chr(169) || ' &amp; ' || p_name AS unescaped, 'a' || chr(233) || '"\\n\\x ' || p_name AS decoded,
strftime(to_timestamp(p_partkey * 86461) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created, p_name AS answer, lower(regexp_replace('A b-' || p_name, '[^A-Za-z0-9_]', '_', 'g')) AS suffix, p_name || '|x|y' AS split, p_name AS said, '{"n": "' || p_name || '"}' AS json,
CASE p_size % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'mix' ELSE 'hybrid' END AS mode, p_size % 3 = 0 AS only_context, p_name AS question FROM part""",
    "answer_rates": "SELECT round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0 END), 6) AS users, round(avg(CASE WHEN length(text) > 200 THEN 1.0 ELSE 0 END), 6) AS long, round(avg(CASE WHEN starts_with(text, 'T') THEN 1.0 ELSE 0 END), 6) AS headed FROM conversations",
}
