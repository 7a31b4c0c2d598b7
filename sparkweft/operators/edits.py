"""Edits of the graph and the bookkeeping around it: validated inserts, property upserts, lookups, trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.text import hash_id, relation_id


def upsert_properties(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows merged by key: a property of ``new`` replaces the old one unless it is null; other properties stay."""
    rest = [c for c in table.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns])
    j = table.join(n, keys, "full_outer")
    return j.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def create_entities(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with those of ``new`` added; fails on use if one is there already."""
    there = new.join(nodes.select("name", F.lit(True).alias("_t")), "name", "left")
    fresh = there.where(F.assert_true(F.col("_t").isNull(), F.concat(F.lit("entity exists: "), "name")).isNull()).drop("_t")
    return nodes.unionByName(fresh, allowMissingColumns=True)


def create_relations(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of ``new(a, b, weight)`` that may be added; with a column ``refused`` for what may not.

    Both ends must be nodes, differ, and not be joined yet.
    """
    n = nodes.select("name")
    k = new.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"), "weight")
    k = k.join(n.select(F.col("name").alias("src"), F.lit(True).alias("_s")), "src", "left").join(n.select(F.col("name").alias("tgt"), F.lit(True).alias("_t")), "tgt", "left")
    k = k.join(edges.select("src", "tgt", F.lit(True).alias("_e")), ["src", "tgt"], "left")
    why = F.when(F.col("src") == F.col("tgt"), "loop").when(F.col("_s").isNull() | F.col("_t").isNull(), "no such entity").when(F.col("_e"), "exists")
    return edges.select("src", "tgt", "weight", F.lit(None).cast("string").alias("refused")).unionByName(k.select("src", "tgt", "weight", why.alias("refused")))


def entity_info(nodes: DataFrame, vectors: DataFrame, names: DataFrame) -> DataFrame:
    """What is known of ``names(name)``: the node and, by its hashed id, whether it has a vector."""
    v = vectors.select(F.col("id").alias("vid"), F.lit(True).alias("has_vector"))
    n = names.join(nodes, "name", "left").withColumn("vid", hash_id("ent-", "name"))
    return n.join(v, "vid", "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))


def relation_rows(edges: DataFrame) -> DataFrame:
    """Edges as rows of a relation vector table: hashed id and the text that is embedded."""
    text = F.concat(F.coalesce("keywords", F.lit("")), F.lit("\t"), "src", F.lit("\n"), "tgt", F.lit("\n"), F.coalesce("description", F.lit("")))
    return edges.select(relation_id("src", "tgt").alias("id"), F.col("src").alias("src_id"), F.col("tgt").alias("tgt_id"), text.alias("content"))


def chunk_trackers(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_ids, count) of source strings joined by the separator, empty parts left out."""
    ids = F.filter(F.split("source_id", "<SEP>"), lambda x: x != "")
    return graph.select(*keys, ids.alias("chunk_ids"), F.size(ids).cast("long").alias("count"))


def update_cache_list(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """``chunks(chunk, keys)`` with the keys of ``new(chunk, keys)`` appended that are not there yet, in order."""
    j = chunks.join(new.select("chunk", F.col("keys").alias("_k")), "chunk", "left")
    return j.select("chunk", F.array_distinct(F.concat("keys", F.coalesce("_k", F.array().cast("array<string>")))).alias("keys"))


def next_status(status: Column, content: Column, failed: Column) -> Column:
    """One step of a document's life: waiting work starts, work ends in processed or failed."""
    return F.when(status.isin("pending", "failed") & content, "processing").when((status == "processing") & failed, "failed").when(status == "processing", "processed").otherwise(status)


def error_documents(errors: DataFrame, at: Column) -> DataFrame:
    """Failed status rows for files that could not be read: ``errors(path, error)``."""
    return errors.where("error is not null").select(hash_id("error-", F.concat("path", "error")).alias("id"), F.col("path").alias("file_path"), F.lit("failed").alias("status"), F.concat(F.lit("[File Extraction]"), "error").alias("content_summary"), F.lit(0).cast("long").alias("content_length"), F.col("error").alias("error_msg"), at.alias("created_at"))


def head_and_tail(tokens: Column, half: int, skip: int = 1000) -> Column:
    """``half`` tokens after the first ``skip`` and ``half`` before the last ``skip``."""
    n = F.size(tokens)
    head = F.slice(tokens, F.lit(skip + 1), F.lit(half))
    start = F.greatest(F.lit(1), n - skip - half + 1)
    tail = F.when(n > skip, F.slice(tokens, start, F.greatest(F.lit(0), F.least(F.lit(half), n - skip)))).otherwise(F.slice(tokens, 1, 0))
    return F.concat(head, tail)


def judge_requests(questions: DataFrame, one: DataFrame, two: DataFrame, model: str = "judge") -> DataFrame:
    """(pos, request): one JSON request for each question with the two answers at the same place."""
    j = questions.join(one.select("pos", F.col("answer").alias("a")), "pos").join(two.select("pos", F.col("answer").alias("b")), "pos")
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer 1: "), "a", F.lit("\nAnswer 2: "), "b")
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
    return j.select("pos", F.to_json(F.struct(F.concat(F.lit("request-"), F.col("pos")).alias("custom_id"), body.alias("body"))).alias("request"))


def context_sections(context: DataFrame) -> DataFrame:
    """(id, section, pos, row) of contexts with fenced JSON-lines sections under headings."""
    both = F.expr("regexp_extract_all(context, '(?m)^[#-]*\\\\s*(\\\\w[\\\\w ]*?)[\\\\s:]*\\n+```json\\n([\\\\s\\\\S]*?)```', 0)")
    s = context.select("id", F.explode(both).alias("part"))
    name = F.lower(F.trim(F.regexp_extract("part", r"^[#-]*\s*(\w[\w ]*)", 1)))
    lines = F.filter(F.split(F.regexp_extract("part", r"```json\n([\s\S]*?)```", 1), "\n"), lambda x: F.trim(x) != "")
    return s.select("id", name.alias("section"), F.posexplode(lines).alias("pos", "row")).withColumn("pos", F.col("pos").cast("long"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def rename_entities(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, renames: DataFrame, merge: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and vectors after entities got other names by ``renames(old, new)``.

    ``nodes(name, ...)``, ``edges(src, tgt, weight)`` and ``vectors(id, v)``,
    whose ids are those of entities (by name) and of relations (by pair). A new
    name that another entity keeps is refused on use, unless ``merge`` allows
    it: then that entity's properties stay, and fill up from those that come to
    it where they are null, in order of the old names. Vectors move to the new
    ids; of several that come to one id the one that was there stays, else that
    of the first old id. Those of relations that became loops go. An old name
    that is no entity does nothing.
    """
    rest = [c for c in nodes.columns if c != "name"]
    there = renames.join(nodes.select(F.col("name").alias("old")), "old", "left_semi").select("old", "new").where("old <> new")
    moved = nodes.join(there.withColumnRenamed("old", "name"), "name", "left")
    # Names that somebody keeps: those asked for must not be among them.
    kept = moved.where("new is null").select(F.col("name").alias("new"), F.lit(True).alias("_kept"))
    asked = moved.where("new is not null").join(kept, "new", "left")
    if not merge:
        twice = F.count(F.lit(1)).over(Window.partitionBy("new")) > 1
        told = F.concat(F.lit("entity exists: "), "new")
        asked = asked.withColumn("_twice", twice).where(F.assert_true(F.col("_kept").isNull() & ~F.col("_twice"), told).isNull()).drop("_twice")
    both = moved.where("new is null").select(F.col("name").alias("_to"), F.lit("").alias("_from"), *rest).unionByName(asked.select(F.col("new").alias("_to"), F.col("name").alias("_from"), *rest))
    # What was there comes first, then old names in order.
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_from", "_to"))).alias(c)
    new_nodes = both.groupBy("_to").agg(*[first(c) for c in rest]).select(F.col("_to").alias("name"), *rest)

    a, b = there.select(F.col("old").alias("src"), F.col("new").alias("_a")), there.select(F.col("old").alias("tgt"), F.col("new").alias("_b"))
    ends = edges.join(a, "src", "left").join(b, "tgt", "left").withColumns({"_x": F.coalesce("_a", "src"), "_y": F.coalesce("_b", "tgt")})
    new_edges = ends.where("_x <> _y").groupBy(F.least("_x", "_y").alias("src"), F.greatest("_x", "_y").alias("tgt")).agg(F.sum("weight").alias("weight"))

    ids = there.select(hash_id("ent-", "old").alias("id"), hash_id("ent-", "new").alias("_id"))
    pairs = ends.where("_a is not null or _b is not null").select(relation_id("src", "tgt").alias("id"), F.when(F.col("_x") != F.col("_y"), relation_id("_x", "_y")).alias("_id"))
    changed = ids.unionByName(pairs).distinct().withColumn("_moves", F.lit(True))
    v = vectors.join(changed, "id", "left").where("_moves is null or _id is not null")
    order = F.struct(F.col("_moves").isNotNull().alias("m"), "id")
    others = [c for c in vectors.columns if c != "id"]
    new_vectors = v.groupBy(F.coalesce("_id", "id").alias("_to")).agg(F.min_by(F.struct(*others), order).alias("_v")).select(F.col("_to").alias("id"), *[F.col("_v")[c].alias(c) for c in others])
    return new_nodes, new_edges, new_vectors
