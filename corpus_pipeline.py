"""A corpus pipeline over ``documents``: five stages, each one operator applied to all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``. Between stages the rows are
written as Parquet below the shared folder and read again; what a stage stored
on its way, and its input, is deleted then. All stages but the last return the
columns of ``documents``.

1. language_id (operator 3): texts in which no language is found go.
2. ngram_jaccard_join (7): of each group of near duplicates (word 5-grams,
   similarity 0.8 or more) the row of smallest id stays; of rows that share
   that id, the one whose text comes first.
3. decontamination (5): texts that hold a benchmark item go.
4. secret_scan (6): secrets become ``[secret]``, and ``n_chars`` follows.
5. bpe (9): texts are encoded and decoded; the digests of both come out.

Rows with null columns pass through stages that do not judge them; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft.llm import bpe, decontaminate, language_id, ngram_join, secret_scan
from sparkweft.llm.common import drop_rows, read_table, settled, small_batches, spent, stored
from sparkweft.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.keep_identified(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    keyed = decontaminate.with_key(docs.select(*COLUMNS))
    # Rows are judged by a key of id and text; equal rows are one group and share it.
    ids = stored(keyed.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "keys")
    groups = ngram_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"), "n_shingles").distinct()
    groups = stored(groups.join(ids, "key"), "groups")
    # The order of a group is that of ids, then of keys; nulls come last.
    first = groups.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    lost = groups.where("n_shingles > 0").select("key").join(first, "key", "left_anti")
    kept = drop_rows(keyed, "key", lost)
    again = stored(ids.join(groups.where("n_shingles > 0").select("key"), "key", "left_semi").where("rows > 1").select("key"), "again")
    if not again.limit(1).count():
        return kept.select(*COLUMNS)
    # Whole rows that repeat: one of each stays, whatever their other columns say.
    once = kept.join(again, "key", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("lang", "source", "n_chars"))).where("nth = 1")
    return kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.redact(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe", encode_tokens),
]

#: No SQL says what the suffix automata, the novelty or the byte pairs give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        spent(before)
    return STAGES[-1][1](spark, docs, sf_dir)
