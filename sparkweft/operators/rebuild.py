"""Rebuilding after deletion, and what a deletion or a merge means for every table of the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.text import hash_id
from sparkweft.operators import extract as X
from sparkweft.operators import merge as M
from sparkweft.sources.store import stored
from sparkweft.sources.store import stored


def _owned(wanted: DataFrame, *keys: str) -> DataFrame:
    return wanted.select(*keys, F.explode("sources").alias("chunk")).distinct()


def keep_only(fragments: DataFrame, limited: DataFrame, known: DataFrame) -> DataFrame:
    """Under KEEP: fragments ``(name, chunk, ...)`` whose chunk is still among the name's ``limited(name, sources)``, or was among its ``known(name, sources)`` before."""
    return fragments.join(_owned(limited, "name").union(_owned(known, "name")).distinct(), ["name", "chunk"], "left_semi")


def propagate_sources(nodes: DataFrame, edges: DataFrame, most: int = 300, keep: str = "KEEP") -> DataFrame:
    """``nodes(name, sources)`` after their ``edges(src, tgt, sources)`` handed them theirs.

    A node's own sources come first, then its edges' by the other end's name;
    each id once, where it first appears. Of more than ``most`` the first stay
    (KEEP) or the last (FIFO). Ids are ranked where they lie, so a hub gathers
    ``most`` of them only.
    """
    own = nodes.select("name", F.lit(0).alias("kind"), F.lit("").alias("other"), F.posexplode("sources").alias("i", "id"))
    both = edges.select(F.col("src").alias("name"), F.col("tgt").alias("other"), "sources").unionByName(edges.select(F.col("tgt").alias("name"), F.col("src").alias("other"), "sources"))
    come = both.join(nodes.select("name"), "name", "left_semi").select("name", F.lit(1).alias("kind"), "other", F.posexplode("sources").alias("i", "id"))
    first = own.unionByName(come).groupBy("name", "id").agg(F.min(F.struct("kind", "other", "i")).alias("at"))
    order = ("at", "id") if keep == "KEEP" else (F.desc("at"), F.desc("id"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("_n") <= most)
    return kept.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s.id).alias("sources"))


def rebuild_nodes(fragments: DataFrame, nodes: DataFrame, edges: DataFrame, wanted: DataFrame, most_sources: int = 300, most_paths: int = 100) -> DataFrame:
    """(name, kind, descriptions, sources, n_sources, paths, how) for every row of ``wanted(name, sources)``.

    A name is made anew of its fragments in the sources it has left. Without
    any it takes the descriptions and paths of its ``edges(src, tgt,
    description, path)`` by the other end's name, and keeps the kind that
    ``nodes(name, kind, description)`` gives it, or is UNKNOWN; without edges
    it keeps its description, too. ``how`` tells which.
    """
    ours = fragments.join(_owned(wanted, "name"), ["name", "chunk"], "left_semi")
    made = stored(M.merge_nodes(ours, most_sources, most_paths).withColumn("how", F.lit("fragments")), "nodes")
    rest = stored(wanted.join(made.select("name"), "name", "left_anti"), "rest")
    both = edges.select(F.col("src").alias("name"), F.col("tgt").alias("other"), "description", "path").unionByName(edges.select(F.col("tgt").alias("name"), F.col("src").alias("other"), "description", "path"))
    near = stored(both.join(rest.select("name"), "name", "left_semi"), "near")
    told = near.where("description <> ''").groupBy("name", "description").agg(F.min("other").alias("at")).groupBy("name").agg(M._in_order(["at", "description"], "description").alias("descriptions"))
    paths = near.groupBy("name", "path").agg(F.min("other").alias("at")).groupBy("name").agg(M.cap_paths(M._in_order(["at", "path"], "path"), most_paths).alias("paths"))
    j = rest.join(nodes.select("name", "kind", "description"), "name", "left").join(M.beside([told, paths], "name"), "name", "left")
    alone = F.array_compact(F.array("description"))
    none = F.array().cast("array<string>")
    other = j.select("name", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), F.coalesce("descriptions", alone, none).alias("descriptions"), "sources", F.size("sources").cast("long").alias("n_sources"), F.coalesce("paths", none).alias("paths"), F.when(F.col("descriptions").isNotNull(), "relations").otherwise("current").alias("how"))
    cols = ["name", "kind", "descriptions", "sources", "n_sources", "paths", "how"]
    return made.select(cols).unionByName(other.select(cols))


def rebuild_edges(fragments: DataFrame, edges: DataFrame, wanted: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """(src, tgt, weight, keywords, n_sources, how) for every row of ``wanted(src, tgt, sources)``.

    Weights of ``fragments(src, tgt, weight, keywords, chunk)`` in the sources
    left add up, their distinct keywords are joined in order; without any the
    weight and keywords of ``edges`` stay. ``owned(src, tgt, chunk)`` may hold
    the sources as rows; ``wanted`` needs none then.
    """
    keys = ["src", "tgt"]
    sources = wanted.select(*keys, F.explode("sources").alias("chunk")) if owned is None else owned.select(*keys, "chunk")
    ours = fragments.join(sources, [*keys, "chunk"], "left_semi")
    # By source first, where the rows lie, so that a pair met a billion times gathers its distinct words only.
    words = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    each = ours.groupBy(*keys, "chunk").agg(F.sum("weight").alias("_w"), F.collect_set(F.when(F.col("keywords") != "", F.col("keywords"))).alias("_k"))
    made = each.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.array_join(F.array_sort(words("_k")), ", ").alias("_k"), F.count(F.lit(1)).alias("_n"))
    j = wanted.select(keys).join(edges.select(*keys, "weight", "keywords"), keys, "left").join(made, keys, "left")
    how = F.when(F.col("_w").isNotNull(), "fragments").otherwise("current")
    return j.select(*keys, F.coalesce("_w", "weight", F.lit(1.0)).alias("weight"), F.coalesce(F.when(F.col("_k") != "", F.col("_k")), "keywords", F.lit("")).alias("keywords"), F.coalesce("_n", F.lit(0)).alias("n_sources"), how.alias("how"))


def rebuild(results: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stubs) anew of cached extraction ``results(chunk, at, path, pass, result)`` in the chunks ``left(chunk)``.

    Results become records; of one name in a chunk the longer description of
    the passes stays; fragments become nodes and edges, and ends that no record
    names become stubs.
    """
    ours = results.join(left, "chunk", "left_semi")
    about = ours.select("chunk", "pass", "at", "path")
    rec = X.records(ours.select(F.struct("chunk", "pass").alias("chunk"), "result"))
    split = lambda d: d.withColumn("pass", F.col("chunk.pass")).withColumn("chunk", F.col("chunk.chunk"))
    ents = X.better(split(X.entities(rec)), ["chunk", "name"]).join(about, ["chunk", "pass"])
    nodes = M.merge_nodes(ents.select("name", F.col("type").alias("kind"), "description", "chunk", "at", "path"))
    rels = split(X.relations(rec)).withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt")).drop("src", "tgt")
    rels = X.better(rels, ["chunk", "a", "b"]).withColumnRenamed("a", "src").withColumnRenamed("b", "tgt")
    weight = rels.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.min("description").alias("description"), F.countDistinct("chunk").alias("n_sources"))
    words = rels.select("src", "tgt", "keywords").distinct().groupBy("src", "tgt").agg(F.array_join(F.array_sort(F.collect_list("keywords")), ", ").alias("keywords"))
    edges = weight.join(words, ["src", "tgt"])
    return nodes, edges, M.stub_nodes(edges, nodes)


def marked(owned: DataFrame, gone: DataFrame) -> DataFrame:
    """``owned`` with ``lost``: whether its chunk is one of ``gone(chunk)``."""
    mark = gone.select("chunk", F.lit(True).alias("_g")).distinct()
    return owned.join(mark, "chunk", "left").withColumn("lost", F.col("_g").isNotNull()).drop("_g")


def verdicts(owned: DataFrame, gone: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, action) of ``owned(keys, chunk)``: delete where no source is left, rebuild where some went, else keep.

    Two flags of each key, combined before they are moved, tell it: sources are
    neither gathered nor made distinct. Without ``gone`` rows bear ``lost``.
    """
    g = (owned if gone is None else marked(owned, gone)).groupBy(*keys).agg(F.bool_and("lost").alias("all"), F.bool_or("lost").alias("some"))
    return g.select(*keys, F.when(F.col("all"), "delete").when(F.col("some"), "rebuild").otherwise("keep").alias("action"))


#: Entities that go and are broadcast at most.
FEW = 1_000_000


def delete_cascade(entities: DataFrame, relations: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(store, key, action): what the loss of chunks ``gone(chunk)`` means for every table.

    ``entities(name, chunk)`` and ``relations(src, tgt, chunk)`` own chunks;
    without ``gone`` their rows bear ``lost`` already (``marked``). A relation
    that keeps sources but loses an end is residual and goes, too. Vectors and
    trackers go with what they belong to; a relation's vector may bear the id
    of either direction. Verdicts are stored, for several tables follow from them.
    """
    e = stored(verdicts(entities, gone, ["name"]), "verdicts")
    r = stored(verdicts(relations, gone, ["src", "tgt"]), "verdicts")
    dead = e.where("action = 'delete'").select("name")
    few = dead.count() <= FEW
    for end in ("src", "tgt"):
        ends = dead.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}"))
        r = r.join(F.broadcast(ends) if few else ends, end, "left")
    lost = (F.col("action") != "delete") & (F.col("_src").isNotNull() | F.col("_tgt").isNotNull())
    r = r.select("src", "tgt", F.when(lost, "residual").otherwise(F.col("action")).alias("action"))
    pair = F.concat_ws("-", "src", "tgt")
    out = e.select(F.lit("entity").alias("store"), F.col("name").alias("key"), "action").unionByName(r.select(F.lit("relation").alias("store"), pair.alias("key"), "action"))
    off = r.where("action in ('delete', 'residual')")
    ids = F.explode(F.array(hash_id("rel-", F.concat("src", "tgt")), hash_id("rel-", F.concat("tgt", "src"))))
    go = F.lit("delete").alias("action")
    vectors = dead.select(F.lit("entity vector").alias("store"), hash_id("ent-", "name").alias("key"), go).unionByName(off.select(F.lit("relation vector").alias("store"), ids.alias("key"), go))
    trackers = dead.select(F.lit("entity chunks").alias("store"), F.col("name").alias("key"), go).unionByName(off.select(F.lit("relation chunks").alias("store"), pair.alias("key"), go))
    return out.unionByName(vectors).unionByName(trackers)


def delete_tracked(names: DataFrame, nodes: DataFrame, edges: DataFrame, node_chunks: DataFrame, edge_chunks: DataFrame) -> dict[str, DataFrame]:
    """The four tables after entities ``names(name)`` went, with their relations and what was tracked of both."""
    gone = names.select("name").distinct()
    alive = lambda d, *ends: _without(d, gone, ends)
    return {"nodes": alive(nodes, "name"), "edges": alive(edges, "src", "tgt"), "node_chunks": alive(node_chunks, "name"), "edge_chunks": alive(edge_chunks, "src", "tgt")}


def _without(d: DataFrame, gone: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for c in ends:
        d = d.join(gone.select(F.col("name").alias(c)), c, "left_anti")
    return d


def merge_tracked(nodes: DataFrame, chunks: DataFrame, plan: DataFrame, strategies: dict[str, str], most: int = 300) -> DataFrame:
    """Merged entities of ``plan(name, new, pos)``: attributes by their strategies in order of ``pos``, and the chunks tracked for them.

    ``chunks(name, chunk)``: those of entities that go come first, in order of
    ``pos``, each where it first appears; ``n_chunks`` counts all, ``chunk_ids``
    holds the first ``most``.
    """
    told = nodes.join(plan, "name").groupBy("new").agg(*[M.merge_attribute(how, c).alias(c) for c, how in strategies.items()])
    first = chunks.join(plan, "name").groupBy("new", "chunk").agg(F.min("pos").alias("pos"))
    n = first.groupBy("new").agg(F.count(F.lit(1)).alias("n_chunks"))
    head = first.withColumn("_n", F.row_number().over(Window.partitionBy("new").orderBy("pos", "chunk"))).where(F.col("_n") <= most)
    head = head.groupBy("new").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "chunk"))), lambda s: s.chunk).alias("chunk_ids"))
    return told.join(n, "new", "left").join(head, "new", "left").select(F.col("new").alias("name"), *strategies, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chunk_ids", F.array().cast("array<bigint>")).alias("chunk_ids"))


def run_documents(docs: DataFrame, contents: DataFrame, chunked: Callable[[DataFrame], DataFrame], failed: Column, error: Column) -> DataFrame:
    """(doc_id, status, n_chunks, error) after all waiting work of ``docs(doc_id, status)`` ran once.

    Rows without content go unless they failed; work that ``failed`` marks ends
    in failed, with its error, the rest in processed, with the number of its
    chunks by ``chunked``; documents that need no work stay.
    """
    from sparkweft.operators.tables import consistent, work_set

    work = consistent(docs, contents).where("status = 'pending'").select("doc_id").join(contents, "doc_id")
    bad = work.where(failed).select("doc_id", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("n_chunks"), error.alias("error"))
    good = work.where(~failed)
    n = chunked(good).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n"))
    good = good.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.lit("processed").alias("status"), F.coalesce("_n", F.lit(0)).alias("n_chunks"), F.lit(None).cast("string").alias("error"))
    lost = consistent(docs, contents).where("status = 'failed'").select("doc_id")
    idle = docs.join(work_set(docs).select("doc_id"), "doc_id", "left_anti").select("doc_id", "status").unionByName(lost.select("doc_id", F.lit("failed").alias("status")))
    return good.unionByName(bad).unionByName(idle.select("doc_id", "status", F.lit(None).cast("long").alias("n_chunks"), F.lit(None).cast("string").alias("error")))


def needs_backfill(docs: DataFrame, tracked: DataFrame, look: int = 5) -> DataFrame:
    """One row (needed): whether none of the first processed documents has a row in ``tracked(doc_id)``."""
    first = docs.where("status = 'processed'").orderBy("doc_id").limit(look)
    j = first.join(tracked.select("doc_id").distinct().withColumn("_t", F.lit(1)), "doc_id", "left")
    return j.agg(((F.count(F.lit(1)) > 0) & (F.count("_t") == 0)).alias("needed"))
