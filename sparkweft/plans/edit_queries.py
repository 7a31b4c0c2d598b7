"""Edits, trackers and evaluation inputs over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import hash_id, words
from sparkweft.operators import edits as E
from sparkweft.operators import fusion as U
from sparkweft.plans import data as D
from sparkweft.plans import graph_queries as Q
from sparkweft.plans import retrieval_queries as R


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_type").alias("kind"), F.col("p_name").alias("description"))


def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    new = D.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey") + 7).alias("name")).agg(F.when(F.min("l_quantity") < 2, F.lit("small lots")).alias("description"))
    return E.upsert_properties(_parts(spark, sf), new, ["name"])


def create_relation(spark: SparkSession, sf: str) -> DataFrame:
    """New pairs offered to the graph: some are there, some have no node, some are loops."""
    p = D.table(spark, sf, "part")
    new = p.select(F.concat(F.lit("P"), "p_partkey").alias("a"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("P"), "p_partkey")).when(F.col("p_size") % 5 == 1, F.lit("nobody")).otherwise(F.concat(F.lit("S"), F.col("p_partkey") % 100)).alias("b"), F.lit(1.0).alias("weight"))
    nodes = _parts(spark, sf).select("name").unionByName(D.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name")))
    out = E.create_relations(D.edges(spark, sf), nodes, new)
    return out.groupBy(F.coalesce("refused", F.lit("kept")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def entity_info(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf).select(hash_id("ent-", "name").alias("id"))
    names = _parts(spark, sf).select("name").unionByName(spark.createDataFrame([("nobody",)], "name string"))
    return E.entity_info(_parts(spark, sf), v, names).select("name", "kind", "vid", "has_vector")


def relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return E.relation_rows(D.edges(spark, sf).withColumn("description", F.lit("supplies")))


def chunk_trackers(spark: SparkSession, sf: str) -> DataFrame:
    g = D.table(spark, sf, "events").groupBy(F.concat(F.lit("U"), "user_id").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "<SEP><SEP>").alias("source_id"))
    return E.chunk_trackers(g, ["name"]).select("name", F.array_join("chunk_ids", ",").alias("chunk_ids"), "count")


def update_cache_list(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations")
    keys = lambda cond: c.where(cond).groupBy(F.col("conv_id").alias("chunk")).agg(F.array_sort(F.collect_list(F.col("turn").cast("string"))).alias("keys"))
    return E.update_cache_list(keys("turn < 3"), keys("role = 'user'")).select("chunk", F.array_join("keys", ",").alias("keys"))


def status_step(spark: SparkSession, sf: str) -> DataFrame:
    s = D.statuses(spark, sf)
    return s.select("doc_id", "status", E.next_status(F.col("status"), F.col("content_length") > 500, F.col("content_length") > 5000).alias("next"))


def head_tail_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(E.head_and_tail(words("text"), 5, 20), " ").alias("summary"))


def question_extraction(spark: SparkSession, sf: str) -> DataFrame:
    from sparkweft.operators.extract import questions

    b = D.table(spark, sf, "benchmark")
    t = F.concat(F.lit("**- Question 1: item "), "item_id", F.lit("?**\n- Question 2: "), F.regexp_replace("text", r"\s+", " "), F.lit(" \n- Answer: none"))
    return b.select("item_id", F.posexplode(questions(t)).alias("pos", "question")).withColumn("pos", F.col("pos").cast("long"))


def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for a judge: whole items as questions, a whole text with the item's number as each of two answers."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "))
    ask = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), plain("text").alias("question"))
    one = D.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), plain("text").alias("answer"))
    two = D.table(spark, sf, "conversations").where("turn = 1").select(F.col("conv_id").alias("pos"), plain("text").alias("answer"))
    return E.judge_requests(ask, one, two)


def context_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts with two sections, rows made of whole conversation turns."""
    c = D.table(spark, sf, "conversations")
    line = F.concat(F.lit('{"s":"'), F.trim(F.regexp_replace("text", r"[^A-Za-z0-9]+", " ")), F.lit('"}'))
    t = F.concat(F.lit("-----Entities-----\n\n```json\n"), line, F.lit("\n"), line, F.lit("\n```\n\n-----Relationships-----\n\n```json\n\n"), line, F.lit("\n```\n"))
    return E.context_sections(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.replace(t, F.lit("-----\n"), F.lit("\n")).alias("context")))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Local and global search interleaved: entities and relations under one numbering each."""
    e = R.round_robin_entities(spark, sf).select(F.lit("entity").alias("section"), "pos", F.col("node").alias("name"))
    r = R.round_robin_relations(spark, sf).select(F.lit("relation").alias("section"), "pos", F.concat_ws("-", "src", "tgt").alias("name"))
    return e.unionByName(r)


def relation_budget(spark: SparkSession, sf: str) -> DataFrame:
    r = Q.relation_topk(spark, sf).withColumn("tokens", (F.length("src") + F.length("tgt")).cast("long"))
    left = U.token_budget_left(300, F.lit(20), F.lit(0), F.lit(10))
    return U.prefix_budget(r.withColumn("left", left), "tokens", 70).select("pos", "src", "tgt", "used", F.col("left").cast("long").alias("left"))


QUERIES = {
    f.__name__: f
    for f in (upsert_nodes, create_relation, entity_info, relation_rows, chunk_trackers, update_cache_list, status_step, head_tail_summary, question_extraction, judge_requests, context_sections, hybrid_search, relation_budget)
}

_P = "p AS (SELECT 'P' || p_partkey AS name, p_type AS kind, p_name AS description FROM part)"
_RR = f"WITH {D.EDGES}, {R._SC}, {R._REL}, {R._BEST}, {R._LOCAL}, {R._RR_E.replace('rr AS', 're AS', 1)}, {R._RR_R}"

ORACLE_SQL = {
    "upsert_nodes": f"WITH {_P}, n AS (SELECT 'P' || (l_partkey + 7) AS name, CASE WHEN min(l_quantity) < 2 THEN 'small lots' END AS d FROM lineitem GROUP BY 1) SELECT coalesce(p.name, n.name) AS name, kind, coalesce(d, description) AS description FROM p FULL JOIN n ON n.name = p.name",
    "create_relation": f"""WITH {D.EDGES}, n AS (SELECT 'P' || p_partkey AS src, CASE p_size % 5 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'nobody' ELSE 'S' || (p_partkey % 100) END AS tgt FROM part),
v AS (SELECT CASE WHEN src = tgt THEN 'loop' WHEN tgt = 'nobody' OR tgt NOT IN (SELECT 'S' || s_suppkey FROM supplier) THEN 'no such entity' WHEN (src, tgt) IN (SELECT (e.src, e.tgt) FROM edges e) THEN 'exists' ELSE 'kept' END AS verdict, 1.0 AS weight FROM n UNION ALL SELECT 'kept', weight FROM edges)
SELECT verdict, count(*) AS n, sum(weight)::DOUBLE AS weight FROM v GROUP BY 1""",
    "entity_info": f"WITH {_P}, {D.VECTORS}, a AS (SELECT name FROM p UNION ALL SELECT 'nobody') SELECT a.name, kind, 'ent-' || md5(a.name) AS vid, a.name IN (SELECT name FROM vec) AS has_vector FROM a LEFT JOIN p ON p.name = a.name",
    "relation_rows": f"WITH {D.EDGES} SELECT 'rel-' || md5(src || tgt) AS id, src AS src_id, tgt AS tgt_id, keywords || chr(9) || src || chr(10) || tgt || chr(10) || 'supplies' AS content FROM edges",
    "chunk_trackers": "SELECT 'U' || user_id AS name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS chunk_ids, count(DISTINCT event_type) AS count FROM events GROUP BY 1",
    "update_cache_list": "WITH a AS (SELECT conv_id AS chunk, list(turn::VARCHAR ORDER BY turn::VARCHAR) AS k FROM conversations WHERE turn < 3 GROUP BY 1), b AS (SELECT conv_id AS chunk, list(turn::VARCHAR ORDER BY turn::VARCHAR) AS k FROM conversations WHERE role = 'user' GROUP BY 1) SELECT a.chunk, array_to_string(list_concat(a.k, list_filter(coalesce(b.k, []), lambda x: NOT list_contains(a.k, x))), ',') AS keys FROM a LEFT JOIN b ON a.chunk = b.chunk",
    "status_step": f"WITH {D.STATUSES} SELECT doc_id, status, CASE WHEN status IN ('pending', 'failed') AND content_length > 500 THEN 'processing' WHEN status = 'processing' AND content_length > 5000 THEN 'failed' WHEN status = 'processing' THEN 'processed' ELSE status END AS next FROM st",
    "head_tail_summary": f"WITH t AS (SELECT doc_id, {D.TERMS} AS w FROM documents) SELECT doc_id, array_to_string(list_concat(w[21:25], CASE WHEN len(w) > 20 THEN w[greatest(1, len(w) - 24) : len(w) - 20] ELSE [] END), ' ') AS summary FROM t",
    "question_extraction": r"SELECT item_id, 0::BIGINT AS pos, 'item ' || item_id || '?' AS question FROM benchmark UNION ALL SELECT item_id, 1, trim(regexp_replace(text, '\s+', ' ', 'g')) FROM benchmark",
    "judge_requests": r"""WITH q AS (SELECT item_id AS pos, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS t FROM benchmark), a AS (SELECT doc_id AS pos, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS a FROM documents), b AS (SELECT conv_id AS pos, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS b FROM conversations WHERE turn = 1)
SELECT pos, '{"custom_id":"request-' || pos || '","body":{"model":"judge","messages":[{"role":"user","content":"Question: ' || t || '\nAnswer 1: ' || a || '\nAnswer 2: ' || b || '"}]}}' AS request FROM q JOIN a USING (pos) JOIN b USING (pos)""",
    "context_sections": """SELECT conv_id * 1000 + turn AS id, section, pos::BIGINT AS pos, '{"s":"' || trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) || '"}' AS row FROM conversations, (VALUES ('entities', 0), ('entities', 1), ('relationships', 0)) t(section, pos)""",
    "hybrid_search": f"{_RR} SELECT 'entity' AS section, pos, node AS name FROM re UNION ALL SELECT 'relation', pos, src || '-' || tgt FROM rr",
    "relation_budget": f"WITH {D.EDGES}, {D.VECTORS}, {D.QUERY}, {Q._REL}, u AS (SELECT pos, src, tgt, sum(length(src) + length(tgt)) OVER (ORDER BY pos)::BIGINT AS used FROM best) SELECT pos, src, tgt, used, 70::BIGINT AS left FROM u WHERE used <= 70",
}
