"""Queries whose tables go through a stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions.text import words
from sparkweft.operators.chunking import token_windows
from sparkweft.plans import data as D
from sparkweft.sources.store import scratch
from sparkweft.streaming import documents as S


def document_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All documents submitted to the stream and worked on until each is processed or, too long at every try, failed."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "n_chars")

    def work(orders: DataFrame) -> DataFrame:
        # Texts are cut where they lie, and only their numbers of chunks move; none is read where no order asks for one.
        mine = orders.join(docs.select("doc_id", "n_chars"), "doc_id")
        bad = F.col("n_chars") > 5000
        fit = docs.where(~bad).select(F.col("doc_id").alias("id"), words("text").alias("terms"))
        if mine.where(~bad).isEmpty():
            fit = fit.where(F.lit(False))
        n = token_windows(fit, 120, 10).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
        return mine.join(n, "doc_id", "left").select(
            "doc_id", F.when(bad, "error").otherwise("done").alias("kind"), "attempt", F.when(~bad, F.coalesce("n", F.lit(0))).alias("n_chunks"), F.when(bad, F.concat(F.lit("too long: "), "n_chars")).alias("error"), F.timestamp_millis(F.col("at_ms") + 1000).alias("at")
        )

    at = scratch(spark, "documents")
    submitted = docs.select("doc_id", F.lit("submit").alias("kind"), F.lit(None).cast("long").alias("attempt"), F.lit(None).cast("long").alias("n_chunks"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    submitted.write.parquet(f"{at}/inbox/submitted")
    S.settle(spark, f"{at}/inbox", f"{at}/state", work, tries=2)
    return S.statuses(spark, f"{at}/state").withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES = {"document_stream": document_stream}

ORACLE_SQL = {
    "document_stream": f"""SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN n_chars > 5000 THEN 2 ELSE 1 END::BIGINT AS attempt,
 CASE WHEN n_chars <= 5000 THEN ceil(len({D.TERMS}) / 110)::BIGINT END AS n_chunks, CASE WHEN n_chars > 5000 THEN 'too long: ' || n_chars END AS error FROM documents d""",
}
