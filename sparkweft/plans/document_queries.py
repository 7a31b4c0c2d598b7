"""Queue, key-value, chunking, extraction and merge queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import text as T
from sparkweft.operators import chunking as C
from sparkweft.operators import extract as X
from sparkweft.operators import merge as M
from sparkweft.operators import tables as K
from sparkweft.operators.packing import pack_groups
from sparkweft.plans import data as D


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.status_counts(D.statuses(spark, sf), total=True)


def docs_paginated(spark: SparkSession, sf: str) -> DataFrame:
    return K.page(D.statuses(spark, sf), 2, 20, "content_length", True, "pending").select("doc_id", "status", "file_path", "content_length")


def work_set(spark: SparkSession, sf: str) -> DataFrame:
    return K.work_set(D.statuses(spark, sf)).select("doc_id", "status")


def enqueue_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    known = d.where("n_chars > 3000").select(T.hash_id("doc-", "text").alias("id")).distinct()
    new = d.select(F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.col("source").alias("file_path"))
    return K.enqueue(new, known, T.summary("content"))


def consistency_check(spark: SparkSession, sf: str) -> DataFrame:
    return K.consistent(D.statuses(spark, sf), D.table(spark, sf, "documents").where("n_chars > 600").select("doc_id")).select("doc_id", "status")


def kv_get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 5), (1, -1), (2, 2), (3, 5)], "pos long, id long")
    t = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return K.get_by_ids(t, asked).select("pos", "id", "source", "n_chars")


def kv_filter_keys(spark: SparkSession, sf: str) -> DataFrame:
    return K.missing_keys(D.table(spark, sf, "labels"), D.table(spark, sf, "documents"), "doc_id")


def kv_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = D.table(spark, sf, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.lit(1).cast("long").alias("create_time"), F.lit(1).cast("long").alias("update_time"))
    new = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("at"))
    return K.upsert(old, new, "id", "at", F.lit(2).cast("long"))


def cache_flatten(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").withColumn("hash", F.concat_ws("-", "conv_id", "turn"))
    kind = F.when(F.col("turn") % 3 > 0, F.col("role"))
    entry = F.struct("hash", F.struct(kind.alias("cache_type"), F.length("text").cast("long").alias("return")))
    nested = c.groupBy("conv_id", F.concat(F.lit("m"), F.col("conv_id") % 4).alias("mode")).agg(F.map_from_entries(F.collect_list(entry)).alias("entries"))
    return K.flatten_cache(nested)


def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    key = T.cache_key(F.concat(F.lit("m"), F.col("conv_id") % 4), F.col("role"), F.md5("text"))
    return c.select(T.cache_key_parts(key).alias("p")).groupBy(F.col("p.mode").alias("mode"), F.col("p.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p.hash").alias("hashes"))


def cached_extractions(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    cache = c.select("key", F.when(F.col("role") == "user", "extract").otherwise("query").alias("cache_type"), ((F.col("conv_id") * 7919 + F.col("turn") * 31) % 1000).alias("create_time"))
    return K.cached_extractions(c.groupBy(F.col("conv_id").alias("chunk")).agg(F.collect_list("key").alias("keys")), cache)


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    return K.token_totals(c.select(F.when(F.col("role") == "user", F.length("text")).cast("long").alias("prompt"), F.when(F.col("role") != "user", F.length("text")).cast("long").alias("completion"), F.when(F.col("turn") == 0, F.lit(7).cast("long")).alias("total")))


def chunk_token_window(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_windows(D.chunks(spark, sf), 120, 10)


def chunk_split_char(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_windows(D.chunks(spark, sf), "\n", 40, 5)


def rerank_chunking(spark: SparkSession, sf: str) -> DataFrame:
    return C.rerank_windows(D.chunks(spark, sf), 48, 8)


def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents")
    md = F.concat(F.lit("# SOURCE_URL: u"), "doc_id", F.lit("\r\n# Title "), "doc_id", F.lit("\nintro\n## First\n"), "text", F.lit("\n## Empty\n\n## Last\nend\n"))
    return C.sections(d.select(F.col("doc_id").alias("id"), md.alias("content")), {"topic": "Topic", "section": "Section", "source": "Source"})


def chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    w = C.split_windows(D.chunks(spark, sf), "\n", 40, 5)
    return C.long_enough(C.unique_chunks(w), 30).select("id", "chunk_id", "chunk_order_index", "valid_index")


def _extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Model output for every customer: an entity and a relation, some with damaged marks."""
    c = D.table(spark, sf, "customer")
    key = F.col("c_custkey")
    mark = F.when(key % 5 == 0, "<|#>").when(key % 5 == 1, "<|##|>").when(key % 5 == 2, "<|\\#|>").otherwise(X.FIELD)
    kind = F.when(key % 7 == 0, "a/b").otherwise(F.initcap("c_mktsegment"))
    e = F.concat_ws("@", F.lit("entity"), F.concat(F.lit('"'), "c_name", F.lit('"')), kind, F.concat(F.lit("balance of "), "c_mktsegment"))
    last = F.when(key % 3 == 0, F.lit("2.5")).otherwise(F.lit("lives there"))
    r = F.concat_ws("@", F.lit("relation"), F.col("c_name"), F.when(key % 11 == 0, F.col("c_name")).otherwise(F.concat(F.lit("nation "), "c_nationkey")), F.lit("home，place"), last)
    return c.select(key.alias("chunk"), F.concat(F.replace(F.concat(e, F.lit("\n"), r), F.lit("@"), mark), F.lit("\n" + X.DONE)).alias("result"))


def parse_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return X.entities(X.records(_extraction(spark, sf)))


def parse_relations(spark: SparkSession, sf: str) -> DataFrame:
    return X.relations(X.records(_extraction(spark, sf)))


def gleaning_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    p = e.select(F.col("user_id").alias("name"), F.concat("event_type", F.lit(" "), F.floor("value").cast("string")).alias("description"), (F.col("event_id") % 2).alias("pass"), F.col("event_id").alias("pos"))
    return X.better(p, ["name"]).select("name", "description", "pass", "pos")


def _node_columns(n: DataFrame) -> DataFrame:
    return n.select("name", "kind", F.array_join("descriptions", M.SEP).alias("descriptions"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), "n_sources", F.array_join("paths", ",").alias("paths"))


def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _node_columns(M.merge_nodes(D.fragments(spark, sf), 20, 3))


def entity_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes anew from the fragments left after the chunks of one path went."""
    return _node_columns(M.merge_nodes(D.fragments(spark, sf).where("path <> 'f0'"), 20, 3))


def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    li = D.table(spark, sf, "lineitem")
    p, s = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    swap = F.col("l_linenumber") % 2 == 0
    return M.merge_edges(li.select(F.when(swap, s).otherwise(p).alias("a"), F.when(swap, p).otherwise(s).alias("b"), F.col("l_quantity").cast("double").alias("weight"), F.concat("l_returnflag", F.lit(", "), "l_linestatus").alias("keywords"), F.col("l_orderkey").alias("chunk")))


def stub_nodes(spark: SparkSession, sf: str) -> DataFrame:
    li = D.table(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"), F.concat("l_returnflag", "l_linestatus").alias("description"))
    return M.stub_nodes(e, D.table(spark, sf, "part").where("p_size < 25").select(F.concat(F.lit("P"), "p_partkey").alias("name")))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").groupBy(F.concat(F.lit("U"), "user_id").alias("name")).agg(F.array_sort(F.collect_list("event_id")).alias("sources"))


def source_limit(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    told = lambda c: F.array_join(c.cast("array<string>"), ",")
    return s.select("name", told(M.limit_ids(F.col("sources"), 5)).alias("fifo"), told(M.limit_ids(F.col("sources"), 5, "KEEP")).alias("keep"), told(M.incremental_ids(F.col("sources"), F.slice("sources", 1, 3), F.slice("sources", 3, 2))).alias("moved"))


def doc_entity_index(spark: SparkSession, sf: str) -> DataFrame:
    ch = D.table(spark, sf, "events").select(F.col("event_id").alias("chunk"), F.floor(F.col("event_id") / 500).alias("doc"))
    return M.owners_by_document(_sources(spark, sf), ch).select("doc", F.array_join("names", ",").alias("names"), "n")


def doc_delete_plan(spark: SparkSession, sf: str) -> DataFrame:
    gone = D.table(spark, sf, "events").where("event_type = 'error' or user_id < 5").select(F.col("event_id").alias("chunk"))
    return K.deletion_plan(_sources(spark, sf), gone).select("name", "action", F.array_join(F.col("left").cast("array<string>"), ",").alias("remaining"))


def custom_kg_load(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.table(spark, sf, "part").where("p_size < 40").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("kind"))
    chunk = D.table(spark, sf, "part").where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("source")).distinct().select("source", T.hash_id("chunk-", "source").alias("chunk"))
    n = parts.join(chunk, "source", "left").select("name", F.coalesce("chunk", F.lit("UNKNOWN")).alias("chunk"), "kind")
    e = D.table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"), F.lit("UNKNOWN").alias("description"))
    return n.unionByName(M.stub_nodes(e, n).select("name", F.col("description").alias("chunk"), "kind"))


def summary_decision(spark: SparkSession, sf: str) -> DataFrame:
    return M.summary_decision(D.table(spark, sf, "conversations").select(F.col("conv_id").alias("name"), F.floor(F.length("text") / 4).cast("long").alias("tokens")), 5, 400)


def description_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_groups(D.table(spark, sf, "conversations").select(F.col("conv_id").alias("name"), F.col("turn").alias("pos"), F.floor(F.length("text") / 4).cast("long").alias("tokens")), 120)


def merge_attributes(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").withColumn("pos", F.col("p_partkey"))
    return p.groupBy("p_brand").agg(M.merge_attribute("keep_first", "p_name").alias("first_name"), M.merge_attribute("keep_last", "p_name").alias("last_name"), M.merge_attribute("join_unique", "p_type").alias("kinds"), M.merge_attribute("join_unique_comma", "p_name").alias("names"), M.merge_attribute("max", "p_retailprice").alias("price"))


def content_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", T.summary("text").alias("summary"), T.hash_id("doc-", "text").alias("id"), T.estimated_tokens("text").alias("tokens"))


def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer")
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('"'), "c_name", F.lit('"'))).when(k % 4 == 1, F.concat(F.lit("<p>"), "c_name", F.lit("</p> "))).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(F.lit("（"), "c_mktsegment", F.lit("）")))
    return c.select("c_custkey", T.normal_name(raw).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (status_counts, docs_paginated, work_set, enqueue_dedup, consistency_check, kv_get_by_ids, kv_filter_keys, kv_upsert, cache_flatten, cache_stats, cached_extractions, token_usage, chunk_token_window, chunk_split_char, rerank_chunking, chunk_semantic, chunk_dedup, parse_extraction, parse_relations, gleaning_merge, node_merge, entity_rebuild, edge_merge, stub_nodes, source_limit, doc_entity_index, doc_delete_plan, custom_kg_load, summary_decision, description_packing, merge_attributes, content_summary, normalize_names)
}

_SRC = "s AS (SELECT 'U' || user_id AS name, list(event_id ORDER BY event_id) AS sources FROM events GROUP BY 1)"
_SUM = "CASE WHEN length(trim(text)) > 250 THEN substr(trim(text), 1, 250) || '...' ELSE trim(text) END"
_SPLIT = r"""p AS (SELECT id, i, string_split(content, chr(10))[i] AS piece FROM (SELECT id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM chunks)),
t AS (SELECT id, i, piece, list_filter(string_split_regex(piece, '\s+'), lambda x: x <> '') AS tk FROM p),
w AS (SELECT id, i, 0 AS j, len(tk) AS tokens, trim(piece) AS content FROM t WHERE len(tk) <= 40
 UNION ALL SELECT id, i, j, least(40, len(tk) - j * 35), array_to_string(tk[j * 35 + 1 : j * 35 + 40], ' ') FROM (SELECT *, unnest(range(0, ceil(len(tk) / 35)::BIGINT)) AS j FROM t WHERE len(tk) > 40)),
o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS chunk_order_index, tokens, content FROM w)"""


def _nodes(where: str = "true") -> str:
    return f"""WITH {D.FRAGMENTS}, f AS (SELECT * FROM frag WHERE {where}),
k AS (SELECT name, kind FROM (SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS r FROM (SELECT name, kind, count(*) AS n, min(chunk) AS f FROM f GROUP BY 1, 2)) WHERE r = 1),
d AS (SELECT name, string_agg(description, '<SEP>' ORDER BY a, -length(description), description) AS descriptions FROM (SELECT name, description, min(f."at") AS a FROM f GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT name, chunk, row_number() OVER (PARTITION BY name ORDER BY chunk DESC) AS r FROM f),
z AS (SELECT name, count(*) AS n_sources, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) FILTER (r <= 20) AS sources FROM s GROUP BY 1),
p AS (SELECT name, list(path ORDER BY c, path) AS l FROM (SELECT name, path, min(chunk) AS c FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT name, kind, descriptions, sources, n_sources, array_to_string(CASE WHEN len(l) > 3 THEN list_append(l[1:3], '...truncated...(FIFO)') ELSE l END, ',') AS paths FROM k JOIN d USING (name) JOIN z USING (name) JOIN p USING (name)"""


ORACLE_SQL = {
    "status_counts": f"WITH {D.STATUSES}, dom(status) AS (VALUES ('pending'), ('processing'), ('preprocessed'), ('processed'), ('failed')) SELECT status, count(doc_id) AS n FROM dom LEFT JOIN st USING (status) GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM st",
    "docs_paginated": f"WITH {D.STATUSES} SELECT doc_id, status, file_path, content_length FROM st WHERE status = 'pending' ORDER BY content_length DESC, doc_id LIMIT 20 OFFSET 20",
    "work_set": f"WITH {D.STATUSES} SELECT doc_id, status FROM st WHERE status IN ('pending', 'failed', 'processing')",
    "enqueue_dedup": f"SELECT 'doc-' || md5(text) AS id, source AS file_path, 'pending' AS status, {_SUM} AS content_summary, length(text)::BIGINT AS content_length FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 AND text NOT IN (SELECT text FROM documents WHERE n_chars > 3000)",
    "consistency_check": f"WITH {D.STATUSES} SELECT st.doc_id, CASE WHEN n_chars > 600 THEN 'pending' ELSE status END AS status FROM st JOIN documents d ON d.doc_id = st.doc_id WHERE status IN ('pending', 'failed', 'processing') AND (n_chars > 600 OR status = 'failed')",
    "kv_get_by_ids": "WITH w(pos, id) AS (VALUES (0, 5), (1, -1), (2, 2), (3, 5)) SELECT pos::BIGINT AS pos, id::BIGINT AS id, source, n_chars FROM w LEFT JOIN documents ON doc_id = id",
    "kv_filter_keys": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "kv_upsert": """WITH o AS (SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_nationkey < 15), n AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1)
SELECT id, value, 1::BIGINT AS create_time, 1::BIGINT AS update_time FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, n.value, CASE WHEN o.id IS NULL THEN 2 ELSE 1 END, 2 FROM n LEFT JOIN o ON o.id = n.id""",
    "cache_flatten": "SELECT 'm' || (conv_id % 4) || ':' || CASE WHEN turn % 3 > 0 THEN role ELSE 'extract' END || ':' || conv_id || '-' || turn AS key, length(text)::BIGINT AS return FROM conversations",
    "cache_stats": "SELECT 'm' || (conv_id % 4) AS mode, role AS kind, count(*) AS n, count(DISTINCT text) AS hashes FROM conversations GROUP BY 1, 2",
    "cached_extractions": "WITH c AS (SELECT conv_id AS chunk, conv_id || '-' || turn AS key, (conv_id * 7919 + turn * 31) % 1000 AS create_time FROM conversations WHERE role = 'user') SELECT chunk, key, create_time, min(create_time) OVER (PARTITION BY chunk) AS chunk_time, row_number() OVER (PARTITION BY chunk ORDER BY create_time, key) AS nth FROM c",
    "token_usage": "SELECT count(*) AS calls, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS prompt, sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END)::BIGINT AS completion, sum(CASE WHEN turn = 0 THEN 7 ELSE length(text) END)::BIGINT AS total FROM conversations",
    "chunk_token_window": f"WITH {D.CHUNKS} SELECT id, i AS chunk_order_index, least(120, len(terms) - i * 110)::BIGINT AS tokens, array_to_string(terms[i * 110 + 1 : i * 110 + 120], ' ') AS content FROM (SELECT *, unnest(range(0, ceil(len(terms) / 110)::BIGINT)) AS i FROM chunks)",
    "chunk_split_char": f"WITH {D.CHUNKS}, {_SPLIT} SELECT id, chunk_order_index, tokens::BIGINT AS tokens, content FROM o",
    "rerank_chunking": f"WITH {D.CHUNKS} SELECT id, i AS part, least(48, len(terms) - i * 40)::BIGINT AS tokens, array_to_string(terms[i * 40 + 1 : i * 40 + 48], ' ') AS content FROM (SELECT *, unnest(range(0, greatest(1, ceil((len(terms) - 8) / 40))::BIGINT)) AS i FROM chunks WHERE len(terms) > 0)",
    "chunk_semantic": r"""WITH d AS (SELECT doc_id AS id, 'Title ' || doc_id AS title, 'u' || doc_id AS u, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents)
SELECT id, i AS chunk_order_index, title, section, '[Topic: ' || title || CASE WHEN section <> '' THEN ' | Section: ' || section ELSE '' END || ' | Source: ' || u || ']' || chr(10) || t AS content
FROM (SELECT id, title, u, 0::BIGINT AS i, '' AS section, 'intro' AS t FROM d UNION ALL SELECT id, title, u, 1, 'First', text FROM d UNION ALL SELECT id, title, u, 3, 'Last', 'end' FROM d) WHERE t <> ''""",
    "chunk_dedup": f"WITH {D.CHUNKS}, {_SPLIT}, u AS (SELECT id, 'chunk-' || md5(content) AS chunk_id, max(chunk_order_index) AS chunk_order_index FROM o WHERE length(content) >= 30 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_order_index) - 1 AS valid_index FROM u",
    "parse_extraction": "SELECT c_custkey AS chunk, 0::BIGINT AS pos, c_name AS name, lower(c_mktsegment) AS type, 'balance of ' || c_mktsegment AS description FROM customer WHERE c_custkey % 7 <> 0",
    "parse_relations": "SELECT c_custkey AS chunk, 1::BIGINT AS pos, c_name AS src, 'nation ' || c_nationkey AS tgt, 'home,place' AS keywords, CASE WHEN c_custkey % 3 = 0 THEN '2.5' ELSE 'lives there' END AS description, CASE WHEN c_custkey % 3 = 0 THEN 2.5 ELSE 1.0 END::DOUBLE AS weight FROM customer WHERE c_custkey % 11 <> 0",
    "gleaning_merge": "SELECT name, description, pass, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(description) DESC, pass, pos) AS r FROM (SELECT user_id AS name, event_type || ' ' || floor(value)::BIGINT AS description, event_id % 2 AS pass, event_id AS pos FROM events)) WHERE r = 1",
    "node_merge": _nodes(),
    "entity_rebuild": _nodes("path <> 'f0'"),
    "edge_merge": """WITH k AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, unnest([l_returnflag, l_linestatus]) AS k FROM lineitem), j AS (SELECT p, s, string_agg(k, ',' ORDER BY k) AS keywords FROM k GROUP BY 1, 2)
SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, sum(l_quantity)::DOUBLE AS weight, count(DISTINCT l_orderkey) AS n_sources, any_value(keywords) AS keywords FROM lineitem JOIN j ON p = l_partkey AND s = l_suppkey GROUP BY 1, 2""",
    "stub_nodes": "WITH e AS (SELECT 'P' || l_partkey AS name, l_returnflag || l_linestatus AS d FROM lineitem UNION ALL SELECT 'S' || l_suppkey, l_returnflag || l_linestatus FROM lineitem) SELECT name, min(d) AS description, 'UNKNOWN' AS kind FROM e WHERE name NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 25) GROUP BY 1",
    "source_limit": f"WITH {_SRC} SELECT name, array_to_string(sources[-5:], ',') AS fifo, array_to_string(sources[1:5], ',') AS keep, array_to_string(list_concat(sources[3:], sources[1:0]), ',') AS moved FROM s",
    "doc_entity_index": "SELECT doc, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT event_id // 500 AS doc, 'U' || user_id AS name FROM events) GROUP BY 1",
    "doc_delete_plan": "SELECT 'U' || user_id AS name, CASE WHEN count(*) FILTER (NOT g) = 0 THEN 'delete' WHEN count(*) FILTER (g) > 0 THEN 'rebuild' ELSE 'keep' END AS action, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (NOT g), '') AS remaining FROM (SELECT *, event_type = 'error' OR user_id < 5 AS g FROM events) GROUP BY 1",
    "custom_kg_load": """WITH n AS (SELECT 'P' || p_partkey AS name, CASE WHEN p_brand < 'Brand#3' THEN 'chunk-' || md5(p_brand) ELSE 'UNKNOWN' END AS chunk, p_type AS kind FROM part WHERE p_size < 40),
e AS (SELECT 'P' || l_partkey AS name FROM lineitem UNION SELECT 'S' || l_suppkey FROM lineitem) SELECT * FROM n UNION ALL SELECT name, 'UNKNOWN', 'UNKNOWN' FROM e WHERE name NOT IN (SELECT name FROM n)""",
    "summary_decision": "SELECT name, n, tokens, CASE WHEN n = 1 THEN 'single' WHEN n < 5 AND tokens < 400 THEN 'join' ELSE 'summarise' END AS action FROM (SELECT conv_id AS name, count(*) AS n, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1)",
    "description_packing": """WITH RECURSIVE c AS (SELECT conv_id AS name, turn AS pos, length(text) // 4 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r(name, i, pos, part, used, held) AS (SELECT name, i, pos, 0::BIGINT, t, 1 FROM c WHERE i = 1 UNION ALL
 SELECT c.name, c.i, c.pos, CASE WHEN held < 2 OR used + t <= 120 THEN part ELSE part + 1 END, CASE WHEN held < 2 OR used + t <= 120 THEN used + t ELSE t END, CASE WHEN held < 2 OR used + t <= 120 THEN held + 1 ELSE 1 END FROM r JOIN c ON c.name = r.name AND c.i = r.i + 1)
SELECT name, pos, part FROM r""",
    "merge_attributes": """WITH k AS (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY 1, 2), t AS (SELECT p_brand, string_agg(p_type, '<SEP>' ORDER BY f) AS kinds FROM k GROUP BY 1), n AS (SELECT p_brand, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY 1)
SELECT p_brand, arg_min(p_name, p_partkey) AS first_name, arg_max(p_name, p_partkey) AS last_name, any_value(kinds) AS kinds, any_value(names) AS names, max(p_retailprice) AS price FROM part JOIN t USING (p_brand) JOIN n USING (p_brand) GROUP BY 1""",
    "content_summary": f"SELECT doc_id, {_SUM} AS summary, 'doc-' || md5(text) AS id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents",
    "normalize_names": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN CASE WHEN c_custkey < 100 THEN '' ELSE c_custkey::VARCHAR END ELSE '(' || c_mktsegment || ')' END AS name FROM customer",
}
