"""Merging fragments into graph nodes and edges; ordered source lists and their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "<SEP>"


def union_ids(old: Column, new: Column) -> Column:
    """Ordered union, first appearance wins."""
    return F.array_distinct(F.concat(old, new))


def limit_ids(ids: Column, most: int, keep: str = "FIFO") -> Column:
    """The newest (FIFO) or the oldest (KEEP) ids, in order; none for a limit of 0 or less."""
    if most <= 0:
        return F.slice(ids, 1, 0)
    if keep == "KEEP":
        return F.slice(ids, 1, most)
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - most + 1), F.lit(most))


def subtract_ids(ids: Column, gone: Column) -> Column:
    """Ordered difference that keeps repeated ids."""
    return F.filter(ids, lambda x: ~F.array_contains(gone, x))


def incremental_ids(existing: Column, old: Column, new: Column) -> Column:
    """Existing ids without those that went from old to new, then those that came."""
    lost = F.array_except(old, new)
    return union_ids(subtract_ids(existing, lost), F.array_except(new, old))


def cap_paths(paths: Column, most: int, mark: str = "...truncated...(FIFO)") -> Column:
    """Distinct file paths; beyond the cap the first ones and a mark."""
    p = F.array_distinct(F.filter(paths, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(p) > most, F.concat(F.slice(p, 1, most), F.array(F.lit(mark)))).otherwise(p)


def _in_order(order: list[str], value: str, distinct: bool = True) -> Column:
    got = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_x")))), lambda s: s["_x"])
    return F.array_distinct(got) if distinct else got


def beside(parts: list[DataFrame], key: str) -> DataFrame:
    """Columns of several frames, each with one row a key, in one row a key.

    Rows are put below each other and grouped once: a chain of joins holds the
    sorts of all its frames in one task.
    """
    out, rest = parts[0], [c for p in parts for c in p.columns if c != key]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest))


def merge_nodes(fragments: DataFrame, most_sources: int = 300, most_paths: int = 100) -> DataFrame:
    """One node a name of ``fragments(name, kind, description, chunk, at, path)``.

    The type is the commonest (first seen on ties); descriptions are distinct,
    by time then longest first; sources and paths are ordered and capped. Equal
    descriptions and sources are made one before anything is gathered, so a
    name met a billion times gathers its distinct parts only.
    """
    kinds = fragments.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first"))
    top = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "first"))
    kind = kinds.withColumn("r", top).where("r = 1").select("name", "kind")
    desc = fragments.groupBy("name", "description").agg(F.min("at").alias("at")).withColumn("neg", -F.length("description"))
    desc = desc.groupBy("name").agg(_in_order(["at", "neg", "description"], "description").alias("descriptions"))
    src = fragments.groupBy("name", "chunk").agg(F.first("path").alias("path"))
    late = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("chunk")))
    n = src.groupBy("name").agg(F.count(F.lit(1)).alias("n_sources"))
    kept = src.withColumn("r", late).where(F.col("r") <= most_sources).groupBy("name").agg(F.array_sort(F.collect_list("chunk")).alias("sources"))
    paths = fragments.groupBy("name", "path").agg(F.min("chunk").alias("first")).groupBy("name").agg(cap_paths(_in_order(["first", "path"], "path"), most_paths).alias("paths"))
    return beside([kind, desc, kept, n, paths], "name").where("name is not null")


def merge_edges(fragments: DataFrame) -> DataFrame:
    """One edge a pair of ``fragments(a, b, weight, keywords, chunk)``: weights add up, keywords are sorted and distinct."""
    f = fragments.where("a <> b").withColumn("src", F.least("a", "b")).withColumn("tgt", F.greatest("a", "b"))
    w = f.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.countDistinct("chunk").alias("n_sources"))
    k = f.select("src", "tgt", F.explode(F.split("keywords", ",")).alias("k")).select("src", "tgt", F.trim("k").alias("k")).where("k <> ''")
    k = k.groupBy("src", "tgt").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keywords"))
    return w.join(k, ["src", "tgt"], "left").select("src", "tgt", "weight", "n_sources", F.coalesce("keywords", F.lit("")).alias("keywords"))


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for edge ends that have none: type UNKNOWN, the smallest edge description."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("name"), "description")
    return ends.join(nodes.select("name"), "name", "left_anti").groupBy("name").agg(F.min("description").alias("description")).withColumn("kind", F.lit("UNKNOWN"))


def owners_by_document(graph: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, names, n): which ``graph(name, sources)`` entries stem from which document, by ``chunks(chunk, doc)``."""
    e = graph.select("name", F.explode("sources").alias("chunk")).join(chunks, "chunk").select("doc", "name").distinct()
    return e.groupBy("doc").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n"))


def summary_decision(descriptions: DataFrame, fewest: int = 8, tokens: int = 1200) -> DataFrame:
    """(name, n, tokens, action): whether descriptions are joined as they are or must be summarised."""
    g = descriptions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    action = F.when(F.col("n") == 1, "single").when((F.col("n") < fewest) & (F.col("tokens") < tokens), "join").otherwise("summarise")
    return g.select("name", "n", "tokens", action.alias("action"))


#: How one attribute of merged entities comes out, by strategy; ``pos`` orders the entities.
def merge_attribute(strategy: str, value: str, pos: str = "pos") -> Column:
    some = F.when(F.col(value).isNotNull() & (F.col(value).cast("string") != ""), F.struct(pos, F.col(value).alias("x")))
    listed = F.transform(F.array_sort(F.collect_list(some)), lambda s: s.x)
    if strategy == "concatenate":
        return F.array_join(listed, "\n\n")
    if strategy == "keep_first":
        return F.min(some).x
    if strategy == "keep_last":
        return F.max(some).x
    if strategy == "join_unique":
        return F.array_join(F.array_distinct(listed), SEP)
    if strategy == "join_unique_comma":
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(listed, lambda s: F.transform(F.split(s, ","), lambda t: F.trim(t)))))), ",")
    if strategy == "max":
        return F.max(value)
    raise ValueError(f"unknown strategy {strategy}")
