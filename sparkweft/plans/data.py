"""How the driver's tables play the engine's roles: vectors, graph, documents, chunks, statuses, fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import words
from sparkweft.operators import graph as G
from sparkweft.operators import lexical as L
from sparkweft.operators import vector as V
from sparkweft.sources.store import fingerprint, kept, spread, stored_at


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, v, bucket): vector i stands for the part i + 1."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("P"), F.col("vec_id") + 1).alias("name"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("bucket"))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> DataFrame:
    """One row (q)."""
    return vectors(spark, sf).where(F.col("id") == vec_id).select(F.col("v").alias("q"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, tgt, weight, keywords): parts and their suppliers, src < tgt. The graph store: made once of each state of its source."""
    li = table(spark, sf, "lineitem")
    return kept(spark, "edges", [li], lambda path: stored_at(_edges(li), path))


#: So many different keywords at most are told by the bits of a number.
BITS = 62


def _edges(li: DataFrame) -> DataFrame:
    """Pairs are grouped by their numbers and named afterwards; their few keywords are bits, which a hash table adds up in place."""
    pair = li.groupBy("l_partkey", "l_suppkey")
    weight = F.count(F.lit(1)).cast("double").alias("weight")
    found = sorted(r[0] for r in li.where("l_returnflag is not null").select("l_returnflag").distinct().limit(BITS + 1).collect())
    if len(found) > BITS:
        e = pair.agg(weight, F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("keywords"))
    else:
        bit = F.coalesce(*(F.when(F.col("l_returnflag") == k, F.lit(1 << i).cast("long")) for i, k in enumerate(found)), F.lit(0).cast("long"))
        e = pair.agg(weight, F.bit_or(bit).alias("bits"))
        e = e.withColumn("keywords", F.concat_ws(",", *(F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(k)) for i, k in enumerate(found))))
    # In order, for files of sorted names are smaller.
    return e.sortWithinPartitions("l_partkey", "l_suppkey").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"), "weight", "keywords")


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """(node, nbr, weight), stored in order of the node, so that the rows of few nodes are few row groups."""
    li = table(spark, sf, "lineitem")
    return kept(spark, "adjacency", [li], lambda path: stored_at(G.adjacency(edges(spark, sf)).repartitionByRange("node", "nbr").sortWithinPartitions("node"), path))


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return kept(spark, "degrees", [li], lambda path: stored_at(G.degrees(edges(spark, sf)), path))


def chunk_index(spark: SparkSession, sf: str) -> L.Index:
    """The words of the chunks, saved once of each state of the documents."""
    docs = table(spark, sf, "documents")
    return kept(spark, "chunk-index", [docs], lambda path: L.save(L.index(_chunks(spread(docs))), path, fingerprint(docs)), lambda path: L.load(spark, path))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(name, terms, v) of the parts that have a vector."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), words(F.concat_ws(" ", "p_name", "p_type")).alias("terms"))
    return p.join(vectors(spark, sf).select("name", "v"), "name")


def entity_index(spark: SparkSession, sf: str) -> L.Index:
    sources = [table(spark, sf, "part"), table(spark, sf, "embeddings")]
    return kept(spark, "entity-index", sources, lambda path: L.save(L.index(entities(spark, sf).withColumnRenamed("name", "id")), path, fingerprint(*sources)), lambda path: L.load(spark, path))


def ivf(spark: SparkSession, sf: str) -> V.Ivf:
    """The vectors in files by their label's bucket, saved once of each state of the embeddings."""
    e = table(spark, sf, "embeddings")
    return kept(spark, "ivf", [e], lambda path: V.ivf_save(vectors(spark, sf), path, fingerprint(e)), lambda path: V.ivf_load(spark, path))


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, tgt, weight): a dense graph of nations that trade more than the mean pair, without loops, src < tgt."""
    li, o = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    pair = j.where("c_nationkey <> s_nationkey").select(F.concat(F.lit("N"), "c_nationkey").alias("a"), F.concat(F.lit("N"), "s_nationkey").alias("b"))
    e = pair.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    mean = e.agg(F.avg("weight").alias("mean"))
    return e.join(F.broadcast(mean), how="cross").where("weight > mean").drop("mean")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(id, file_path, content, tokens): documents as chunks, tokens by white space."""
    return _chunks(table(spark, sf, "documents"))


def _chunks(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("text").alias("content"), words("text").alias("terms"))


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, status, file_path, content_length): a queue made of documents and labels."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    s = F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "processed").otherwise("processing")
    return d.join(l, "doc_id", "left").select("doc_id", s.alias("status"), F.col("source").alias("file_path"), F.length("text").cast("long").alias("content_length"))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """(name, kind, description, chunk, at, path): entity fragments out of events."""
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("U"), "user_id").alias("name"), F.col("event_type").alias("kind"), F.col("props").alias("description"), F.col("event_id").alias("chunk"), F.col("ts").alias("at"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("path"))


# The same roles in the oracle's SQL.
VECTORS = "vec AS (SELECT vec_id AS id, 'P' || (vec_id + 1) AS name, embedding::DOUBLE[] AS v, label::BIGINT AS bucket FROM embeddings)"
QUERY = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
EDGES = """edges AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, count(*)::DOUBLE AS weight, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS keywords FROM lineitem GROUP BY 1, 2)"""
NATIONS = """e0 AS (SELECT least('N' || c_nationkey, 'N' || s_nationkey) AS src, greatest('N' || c_nationkey, 'N' || s_nationkey) AS tgt, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edges AS (SELECT * FROM e0 WHERE weight > (SELECT avg(weight) FROM e0))"""
ADJ = "adj AS (SELECT src AS node, tgt AS nbr, weight FROM edges UNION ALL SELECT tgt, src, weight FROM edges), deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY 1)"
TERMS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
CHUNKS = f"chunks AS (SELECT doc_id AS id, source AS file_path, text AS content, {TERMS} AS terms FROM documents)"
STATUSES = "st AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'processed' ELSE 'processing' END AS status, source AS file_path, length(text)::BIGINT AS content_length FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
FRAGMENTS = "frag AS (SELECT 'U' || user_id AS name, event_type AS kind, props AS description, event_id AS chunk, ts AS at, 'f' || (event_id % 7) AS path FROM events)"
