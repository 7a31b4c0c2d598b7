"""Streaming ingestion: files arrive, documents are queued once, chunks follow. State is the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkweft.functions.text import summary, words
from sparkweft.operators.chunking import token_windows
from sparkweft.operators.tables import enqueue

STATUS = "id string, file_path string, status string, content_summary string, content_length long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def ingest_batch(spark: SparkSession, batch: DataFrame, folder: str, batch_id: int, size: int = 1200, overlap: int = 100) -> None:
    """Queue and chunk the new documents of ``batch(file_path, content)``.

    Each batch writes folders named by its id and replaces them, so a repeated
    batch leaves the same tables; documents known from other batches are not
    queued again.
    """
    known = _table(spark, f"{folder}/status", "batch long, " + STATUS).where(F.col("batch") != batch_id)
    rows = batch.where(F.trim("content") != "").withColumn("pos", F.col("file_path"))
    new = enqueue(rows, known, summary("content"))
    new.withColumn("status", F.lit("processed")).write.mode("overwrite").parquet(f"{folder}/status/batch={batch_id}")
    done = spark.read.schema(STATUS).parquet(f"{folder}/status/batch={batch_id}")
    docs = rows.select(F.concat(F.lit("doc-"), F.md5("content")).alias("id"), "content").dropDuplicates(["id"]).join(done.select("id"), "id", "left_semi")
    token_windows(docs.withColumn("terms", words("content")), size, overlap).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")


def start(spark: SparkSession, source: str, folder: str, size: int = 1200, overlap: int = 100, on_batch: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """A query that ingests whole text files from ``source`` as they appear; ``trigger`` as for writeStream."""
    files = spark.readStream.format("text").option("wholetext", "true").load(source).select(F.col("value").alias("content"), F.input_file_name().alias("file_path"))

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch.sparkSession, batch, folder, batch_id, size, overlap)
        if on_batch:
            on_batch(batch_id)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
