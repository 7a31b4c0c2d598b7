"""Fusing ranked lists: interleaving, budgets, chunk picking, references. Every list carries its order in ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators.ranking import numbered, running


def round_robin(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Lists of ``(pos, keys..., others)`` taken in turn, the first of equal keys kept; columns pos, keys, source."""
    tagged = [d.select("pos", *keys, F.lit(i).alias("source")) for i, d in enumerate(lists)]
    u = tagged[0]
    for d in tagged[1:]:
        u = u.unionByName(d)
    first = u.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "source"))).where("_n = 1")
    return numbered(first.select("pos", *keys, "source"), "pos", "source", name="out").select(F.col("out").alias("pos"), *keys, "source")


def prefix_budget(rows: DataFrame, tokens: str, budget: int, *, by: str | None = None, order: str = "pos") -> DataFrame:
    """The longest prefix whose tokens fit; nothing after the first that does not is looked at."""
    if by is None:
        return running(rows, tokens, order).where(F.col("used") <= budget)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def occurrences(owners: DataFrame) -> DataFrame:
    """(owner, chunk, n, pos) of ``owners(owner, chunks array)`` in owner order.

    Each chunk stays with its first owner; an owner's chunks go by how many
    owners have them, then by their own order.
    """
    e = owners.select("owner", F.posexplode("chunks").alias("i", "chunk")).where("chunk is not null and chunk <> ''")
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chunk"))).withColumn("_f", F.row_number().over(Window.partitionBy("chunk").orderBy("owner", "i"))).where("_f = 1")
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "i")).cast("long")).select("owner", "chunk", "n", "pos")


def pick_polling(chunks: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Chunks of ranked owners by linear quotas: the first owner may give ``most``, the last ``least``.

    What owners cannot give goes to owners that have more, the first ones
    first. ``chunks(owner, pos, chunk)``, owners numbered from 1 without gaps.
    """
    size = chunks.groupBy("owner").agg(F.max("pos").alias("have"))
    n = size.agg(F.max("owner").alias("n"))
    line = F.when(F.col("n") > 1, F.bround(most - (most - least) * (F.col("owner") - 1) / (F.col("n") - 1))).otherwise(F.lit(float(most)))
    q = size.join(F.broadcast(n), how="cross").withColumn("quota", line.cast("long"))
    left = q.agg(F.sum(F.col("quota") - F.least("quota", "have")).alias("spare"))
    c = chunks.join(q.select("owner", "quota"), "owner")
    first = c.where("pos <= quota")
    over = numbered(c.where("pos > quota"), "owner", "pos", name="nth").join(F.broadcast(left), how="cross").where("nth <= spare")
    return first.select("owner", "pos", "chunk", F.lit(1).alias("round")).unionByName(over.select("owner", "pos", "chunk", F.lit(2).alias("round")))


def pick_vector(asked: DataFrame, vectors: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """The n chunks of ``asked(id)`` nearest to the query, or none if any chunk has no vector."""
    miss = asked.join(vectors.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    s = scored.join(asked.select("id").distinct(), "id", "left_semi").join(F.broadcast(miss), how="cross").where("missing = 0")
    return s.select("id", "score").orderBy(F.desc("score"), "id").limit(n)


def postprocess(chunks: DataFrame, least: float, k: int, budget: int) -> DataFrame:
    """Scored chunks ``(pos, id, score, tokens)``: a floor on scores (missing ones count as 1), the first k, a token budget, numbers."""
    kept = chunks.where(F.coalesce("score", F.lit(1.0)) >= least).orderBy("pos").limit(k)
    return prefix_budget(kept, "tokens", budget).withColumn("ref", F.concat(F.lit("DC"), F.row_number().over(Window.orderBy("pos")))).select("pos", "id", "score", "tokens", "ref")


def references(chunks: DataFrame) -> DataFrame:
    """(reference_id, file_path, n) of ``chunks(pos, file_path)``: the most used path first, the first seen on ties."""
    g = chunks.where("file_path is not null and file_path not in ('', 'unknown_source')").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return g.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("string").alias("reference_id"), "file_path", "n")


def user_format(entities: DataFrame, relations: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """One row (status, message, data<entities, relationships, chunks, references>) of four short ranked lists."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        order = "pos" if "pos" in df.columns else df.columns[0]
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("r")))), lambda x: x.r).alias(name))

    one = packed(entities, "entities").join(packed(relations, "relationships"), how="cross").join(packed(chunks, "chunks"), how="cross").join(packed(refs, "references"), how="cross")
    return one.select(F.lit("success").alias("status"), F.lit("Query executed successfully").alias("message"), F.struct("entities", "relationships", "chunks", "references").alias("data"))


def token_budget_left(total: int, system: Column, graph: Column, query: Column, buffer: int = 200) -> Column:
    return F.greatest(F.lit(0), total - (system + graph + query + buffer))


def context_lines(rows: DataFrame, order: str = "pos") -> DataFrame:
    """One row (context): the rows as JSON lines in order."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*[c for c in rows.columns if c != order])).alias("j")))), lambda s: s.j), "\n").alias("context"))
