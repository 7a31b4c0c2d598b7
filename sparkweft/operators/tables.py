"""Keyed tables and the document queue: aligned gets, anti-joins, upserts, pages, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["pending", "processing", "preprocessed", "processed", "failed"]


def get_by_ids(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows in the order asked for in ``wanted(pos, key)``: a miss is a row of nulls, a repeated key a repeated row."""
    return wanted.join(table, key, "left")


def missing_keys(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, order: str, now: Column) -> DataFrame:
    """Rows replaced by key, the last of ``new`` by ``order`` wins; create_time stays, update_time moves."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    kept = table.join(last.select(key), key, "left_anti")
    old = table.select(key, F.col("create_time").alias("_c"))
    fresh = last.join(old, key, "left").withColumn("create_time", F.coalesce("_c", now)).withColumn("update_time", now).drop("_c")
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def flatten_cache(nested: DataFrame) -> DataFrame:
    """(mode, entries map<hash, struct<cache_type, return>>) to one row a key ``mode:type:hash``."""
    e = nested.select("mode", F.explode("entries").alias("hash", "entry"))
    return e.select(F.concat_ws(":", "mode", F.coalesce("entry.cache_type", F.lit("extract")), "hash").alias("key"), F.col("entry.return").alias("return"))


def status_counts(docs: DataFrame, total: bool = False) -> DataFrame:
    """Documents of every status there is, 0 where none has it; with ``total`` also a row ``all``."""
    domain = docs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = domain.join(docs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return n.unionByName(n.agg(F.sum("n").alias("n")).select(F.lit("all").alias("status"), "n")) if total else n


def by_status(docs: DataFrame, *status: str) -> DataFrame:
    return docs.where(F.col("status").isin(*status)).withColumn("file_path", F.coalesce("file_path", F.lit("no-file-path")))


def by_track(docs: DataFrame, track: str) -> DataFrame:
    return docs.where(F.col("track_id") == track)


def first_by_path(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col("file_path") == path).orderBy(key).limit(1)


def by_prefix(table: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """Rows whose key begins with a prefix; the filter reaches the scan."""
    return table.where(F.col(key).startswith(prefix))


SORTABLE = {"doc_id", "file_path", "content_length", "created_at", "updated_at", "id"}


def page(docs: DataFrame, number: int = 1, size: int = 50, sort: str = "doc_id", descending: bool = True, status: str | None = None, key: str = "doc_id") -> DataFrame:
    """One page of documents; size is held between 10 and 200, the number above 0, unknown sort fields fall back to the id."""
    number, size = max(1, number), max(10, min(200, size))
    by = F.col(sort if sort in SORTABLE and sort in docs.columns else key)
    rows = docs if status is None else docs.where(F.col("status") == status)
    return rows.orderBy(by.desc() if descending else by.asc(), key).offset((number - 1) * size).limit(size)


def shown_status(status: Column, multimodal_done: Column) -> Column:
    """A processed document whose pictures and tables are not done yet is preprocessed."""
    return F.when((status == "processed") & (multimodal_done == F.lit(False)), "preprocessed").otherwise(status)


def enqueue(new: DataFrame, known: DataFrame, summary: Column) -> DataFrame:
    """Rows of ``new(pos, content, file_path)`` to be worked on: the first of equal contents, unless its id is known. Contents are told apart by their hashes, so no text is moved to find repeats."""
    rows = new.select(F.concat(F.lit("doc-"), F.md5("content")).alias("id"), "pos", "file_path", summary.alias("content_summary"), F.length("content").cast("long").alias("content_length"))
    first = rows.groupBy("id").agg(F.min(F.struct("pos", "file_path", "content_summary", "content_length")).alias("f"))
    return first.join(known.select("id"), "id", "left_anti").select("id", "f.file_path", F.lit("pending").alias("status"), "f.content_summary", "f.content_length")


def work_set(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status").isin("processing", "failed", "pending"))


def consistent(docs: DataFrame, contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Work after a restart: rows without content go unless they failed; what was under way or failed with content is pending again."""
    has = contents.select(key, F.lit(True).alias("_has"))
    j = work_set(docs).join(has, key, "left").where(F.col("_has") | (F.col("status") == "failed"))
    return j.withColumn("status", F.when(F.col("_has"), "pending").otherwise(F.col("status"))).drop("_has")


def deletion_plan(owners: DataFrame, gone: DataFrame) -> DataFrame:
    """What a document's deletion means for each ``owners(name, sources array)``: delete, rebuild or keep, and the sources left."""
    chunks = gone.select(F.col("chunk").alias("_g")).distinct()
    each = owners.select("name", F.posexplode("sources").alias("i", "chunk"))
    marked = each.join(chunks, F.col("chunk") == F.col("_g"), "left")
    g = marked.groupBy("name").agg(F.count(F.lit(1)).alias("had"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_g").isNull(), F.struct("i", "chunk")))), lambda s: s.chunk).alias("left"))
    action = F.when(F.size("left") == 0, "delete").when(F.size("left") < F.col("had"), "rebuild").otherwise("keep")
    return g.select("name", action.alias("action"), "left")


def cached_extractions(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached extraction results of ``chunks(chunk, keys array)``: by time in a chunk, chunks by their first."""
    hit = chunks.select("chunk", F.explode("keys").alias("key")).join(cache.where("cache_type = 'extract'"), "key")
    first = F.min("create_time").over(Window.partitionBy("chunk"))
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy("create_time", "key"))
    return hit.select("chunk", "key", "create_time", first.alias("chunk_time"), nth.cast("long").alias("nth"))


def token_totals(usage: DataFrame) -> DataFrame:
    """Sums of prompt, completion and total tokens; a missing total is the sum of the two."""
    z = F.lit(0)
    return usage.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("prompt", z)).alias("prompt"), F.sum(F.coalesce("completion", z)).alias("completion"), F.sum(F.coalesce("total", F.coalesce("prompt", z) + F.coalesce("completion", z))).alias("total"))


def is_empty(table: DataFrame) -> DataFrame:
    """One row (is_empty)."""
    return table.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def cleared(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)


def delete_class(cache: DataFrame, mode: str | None = None, kind: str | None = None, key: str = "key") -> DataFrame:
    """Cache rows but for those of one class: of a mode, of a kind, or both; rows whose key has no class stay."""
    parts = F.split(key, ":", 3)
    hit = F.size(parts) == 3
    if mode is not None:
        hit = hit & (F.get(parts, F.lit(0)) == mode)
    if kind is not None:
        hit = hit & (F.get(parts, F.lit(1)) == kind)
    return cache.where(~hit)
