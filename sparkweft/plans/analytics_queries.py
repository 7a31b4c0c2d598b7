"""Analytics queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import words
from sparkweft.operators import analytics as A
from sparkweft.plans import data as D

TYPES = ["ECONOMY", "STANDARD", "supplier"]


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.col("p_type").alias("kind"))
    return p.unionByName(D.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.when(F.col("s_nationkey") < 20, "supplier").otherwise("unknown").alias("kind")))


def schema_correctness(spark: SparkSession, sf: str) -> DataFrame:
    return A.schema_correctness(D.edges(spark, sf), _nodes(spark, sf), TYPES, 3)


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(_nodes(spark, sf), "kind")


def type_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return A.entropy(_nodes(spark, sf), "kind")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", F.size(words("text")).cast("long").alias("tokens"))


def token_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.token_distribution(_sizes(spark, sf), "tokens")


def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.token_buckets(_sizes(spark, sf), "tokens", [50, 100, 200, 500, 1000])


def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no label refers to."""
    return D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id", "left_anti").groupBy(F.col("source").alias("file_path")).agg(F.count(F.lit(1)).alias("orphans"))


def category_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = A.first_category(F.col("p_name"), [("metal", "bolt|gear"), ("round", "ring"), ("small", "^small")])
    return A.histogram(D.table(spark, sf, "part").select(c.alias("category")), "category")


def eval_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("user_id") % 10 == 0, F.lit(None)).otherwise(F.col("value"))
    return A.eval_stats(e.select("event_type", F.pmod("event_id", F.lit(3)).alias("part"), v.cast("double").alias("score")), "part", "score")


def mode_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select((F.col("user_id") % 20).alias("question"), F.element_at(F.array(F.lit("hybrid"), F.lit("mix"), F.lit("beam")), (F.col("event_id") % 3 + 1).cast("int")).alias("mode"), "value")
    return A.mode_summary(e, "question", "mode", "value", ["hybrid", "mix", "beam"])


def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    w = F.when(F.col("value") < 10, "A").when(F.col("value") < 25, "B").otherwise("Tie")
    return A.win_rates(e.select(F.col("event_type").alias("criterion"), w.alias("winner"), (F.col("event_id") % 2 == 1).alias("swapped")))


def build_time(spark: SparkSession, sf: str) -> DataFrame:
    return A.build_time(D.table(spark, sf, "events"), "user_id", "ts")


def eval_split(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").groupBy(A.in_eval(F.col("source"), 30).alias("in_eval")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("files"))


def triplets(spark: SparkSession, sf: str) -> DataFrame:
    return A.triplets(D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path")), 2)


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance judgements of the evaluation files: a chunk is relevant to its own question."""
    d = D.table(spark, sf, "documents").where(A.in_eval(F.col("source"), 30))
    return d.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("corpus_id"), F.lit(1).cast("long").alias("score"))


def mrr_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval of an order's parts by price: metrics of that ranking against the large lines."""
    from pyspark.sql import Window

    li = D.table(spark, sf, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")).alias("rank")).dropDuplicates(["query", "id", "rank"])
    hits = hits.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    rel = li.where("l_quantity >= 25").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("id")).distinct()
    return A.retrieval_metrics(hits, rel)


def answer_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each turn its predecessor said."""
    c = D.table(spark, sf, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), words("text").alias("b"))
    return c.select("conv_id", "turn", words("text").alias("a")).join(prev, ["conv_id", "turn"]).select("conv_id", "turn", A.overlap(F.col("a"), F.col("b")).alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (schema_correctness, type_histogram, type_entropy, token_distribution, token_histogram, orphan_chunks, category_rules, eval_stats, mode_summary, win_rates, build_time, eval_split, triplets, qrels, mrr_recall, answer_overlap)
}

_N = "n AS (SELECT 'P' || p_partkey AS name, p_type AS kind FROM part UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_nationkey < 20 THEN 'supplier' ELSE 'unknown' END FROM supplier)"
_TOK = f"t AS (SELECT len({D.TERMS}) AS tokens FROM documents)"
_EVAL = "(('0x' || substr(md5(source), 1, 6))::BIGINT % 100 < 30)"

ORACLE_SQL = {
    "schema_correctness": f"WITH {D.EDGES}, {_N} SELECT CASE WHEN length(src) < 3 OR length(tgt) < 3 THEN 'short name' WHEN a.kind IS NULL OR a.kind NOT IN ('ECONOMY', 'STANDARD', 'supplier') THEN 'source type ' || coalesce(a.kind, 'none') WHEN b.kind IS NULL OR b.kind NOT IN ('ECONOMY', 'STANDARD', 'supplier') THEN 'target type ' || coalesce(b.kind, 'none') ELSE 'ok' END AS violation, count(*) AS n FROM edges LEFT JOIN n a ON a.name = src LEFT JOIN n b ON b.name = tgt GROUP BY 1",
    "type_histogram": f"WITH {_N} SELECT kind, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM n), 4) AS percent FROM n GROUP BY 1",
    "type_entropy": f"WITH {_N}, p AS (SELECT count(*) / (SELECT count(*) FROM n) AS p FROM n GROUP BY kind) SELECT round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised FROM p",
    "token_distribution": f"WITH {_TOK}, o AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS i, count(*) OVER () AS n FROM t) SELECT max(n) AS n, min(tokens) AS least, max(tokens) AS greatest, round(avg(tokens), 6) AS mean, max(tokens) FILTER (i = floor(n * 0.1)) AS p10, max(tokens) FILTER (i = floor(n * 0.5)) AS p50, max(tokens) FILTER (i = floor(n * 0.9)) AS p90 FROM o",
    "token_histogram": f"WITH {_TOK} SELECT CASE WHEN tokens < 50 THEN '0-49' WHEN tokens < 100 THEN '50-99' WHEN tokens < 200 THEN '100-199' WHEN tokens < 500 THEN '200-499' WHEN tokens < 1000 THEN '500-999' ELSE '1000+' END AS bucket, count(*) AS n FROM t GROUP BY 1",
    "orphan_chunks": "SELECT source AS file_path, count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "category_rules": "WITH c AS (SELECT CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%gear%' THEN 'metal' WHEN p_name LIKE '%ring%' THEN 'round' WHEN p_name LIKE 'small%' THEN 'small' ELSE 'other' END AS category FROM part) SELECT category, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM c), 4) AS percent FROM c GROUP BY 1",
    "eval_stats": "WITH e AS (SELECT event_id % 3 AS part, CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN NULL ELSE value END AS v FROM events) SELECT part, count(*) AS n, count(v) AS valid, round(count(v) / count(*), 6) AS success, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest FROM e GROUP BY 1",
    "mode_summary": """WITH p AS (SELECT user_id % 20 AS question, avg(value) FILTER (event_id % 3 = 0) AS h, avg(value) FILTER (event_id % 3 = 1) AS m, avg(value) FILTER (event_id % 3 = 2) AS b FROM events GROUP BY 1)
SELECT question, round(h, 6) AS hybrid, round(m, 6) AS mix, round(b, 6) AS beam, CASE greatest(h, m, b) WHEN h THEN 'hybrid' WHEN m THEN 'mix' ELSE 'beam' END AS winner, round(greatest(h, m, b) - least(h, m, b), 6) AS spread, round(100 * (greatest(h, m, b) - h) / h, 4) AS versus FROM p""",
    "win_rates": "WITH w AS (SELECT event_type AS criterion, CASE WHEN value >= 25 THEN 'T' WHEN (value < 10) = (event_id % 2 = 0) THEN 'A' ELSE 'B' END AS w FROM events) SELECT criterion, count(*) AS n, round(100.0 * count(*) FILTER (w = 'A') / count(*), 4) AS a, round(100.0 * count(*) FILTER (w = 'B') / count(*), 4) AS b, round(100.0 * count(*) FILTER (w = 'T') / count(*), 4) AS tie FROM w GROUP BY 1",
    "build_time": "WITH d AS (SELECT epoch(min(ts)) AS a, epoch(max(ts)) AS b FROM events GROUP BY user_id) SELECT count(*) AS docs, round(max(b) - min(a), 3) AS wall, round(avg(b - a), 3) AS mean, round(quantile_cont(b - a, 0.5), 3) AS median, round(min(b - a), 3) AS least, round(max(b - a), 3) AS greatest, round(sum(b - a) / (max(b) - min(a)), 4) AS parallelism, round(3600 * count(*) / (max(b) - min(a)), 4) AS per_hour FROM d",
    "eval_split": f"SELECT {_EVAL} AS in_eval, count(*) AS n, count(DISTINCT source) AS files FROM documents GROUP BY 1",
    "triplets": """WITH f AS (SELECT source, size, row_number() OVER (ORDER BY md5(source)) - 1 AS f, count(*) OVER () AS m FROM (SELECT source, count(*) AS size FROM documents GROUP BY 1)),
c AS (SELECT doc_id AS id, f, m, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents JOIN f USING (source)), n(nth) AS (VALUES (1::BIGINT), (2))
SELECT c.id AS query, c.id AS positive, o.id AS negative, nth FROM c, n JOIN f g ON g.f = (c.f + nth) % c.m JOIN c o ON o.f = g.f AND o.i = c.i % g.size WHERE nth < c.m""",
    "qrels": f"SELECT 'q' || doc_id AS query_id, 'd' || doc_id AS corpus_id, 1::BIGINT AS score FROM documents WHERE {_EVAL}",
    "mrr_recall": """WITH l AS (SELECT * FROM lineitem), h AS (SELECT q, id, min(r) AS r FROM (SELECT l_orderkey AS q, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM l) GROUP BY 1, 2),
rel AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS id FROM l WHERE l_quantity >= 25), g AS (SELECT rel.q, count(*) AS n, min(r) AS f, count(*) FILTER (r <= 1) AS h1, count(*) FILTER (r <= 5) AS h5, count(*) FILTER (r <= 10) AS h10, sum(1 / log2(r + 1)) FILTER (r <= 10) AS dcg FROM rel LEFT JOIN h ON h.q = rel.q AND h.id = rel.id GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN f <= 10 THEN 1 / f ELSE 0 END), 6) AS mrr, round(avg(h1 / n), 6) AS recall_1, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1 / log2(x + 1)))), 6) AS ndcg FROM g""",
    "answer_overlap": f"WITH c AS (SELECT conv_id, turn, list_distinct({D.TERMS}) AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(b.w) ELSE 0 END, 6)::DOUBLE AS overlap FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1",
}
