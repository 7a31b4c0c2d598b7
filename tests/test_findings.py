"""What earlier queries got wrong, left out, or could not hold at size."""

import random

import duckdb
from pyspark.sql import functions as F

from sparkweft.operators import lexical as L
from sparkweft.operators import merge as M
from sparkweft.operators import rebuild as B
from sparkweft.operators import segments as S
from sparkweft.operators import triangles as T
from sparkweft.operators import vector as V
from sparkweft.plans import data as D
from sparkweft.plans import graph_queries as GQ
from sparkweft.plans import registry


def tables(spark, path, **made):
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_any_order_deletes_its_customer(spark, tmp_path):
    """Orders that are open or in part done count as well as finished ones."""
    customer = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "c_custkey long, c_name string")
    orders = spark.createDataFrame([(1, "F"), (2, "O"), (3, "P")], "o_custkey long, o_orderstatus string")
    sf = tables(spark, tmp_path, customer=customer, orders=orders)
    assert sorted(r.c_custkey for r in registry.QUERIES["kv_delete"](spark, sf).collect()) == [0, 4]


def test_means_are_those_of_the_numbers_as_written(spark):
    """32 prices whose mean lies at a half of the last place; added up as doubles they fall short of it."""
    cents = [5984, 5000, 4737, 10578, 10114, 3602, 16954, 19822, 9717, 4238, 6874, 4742, 17974, 1140, 10456, 18219, 6831, 5937, 9895, 14276, 17712, 5273, 1691, 8203, 8376, 2210, 14737, 14195, 18098, 8299, 17839, 14498]
    for order in (cents, sorted(cents)):
        rows = [(1, i, c / 100) for i, c in enumerate(order)] + [(2, 0, 1e300), (2, 1, 1e300), (3, 0, None), (3, 1, 0.5), (4, 0, float("inf"))]
        parts = spark.createDataFrame(rows, "doc long, pos long, score double").coalesce(1)
        assert {r.doc: r.score for r in L.rerank_aggregate(parts, "mean").collect()} == {1: 99.444063, 2: 1e300, 3: 0.5, 4: float("inf")}


def planned(spark, make):
    """The plan of what ``make`` returns, as it is where no side is small enough to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merging_nodes_holds_no_chain_of_sorts(spark):
    """Parts of nodes are laid below each other and grouped, so a task holds the sorts of one part only."""
    rows = [("a", None, "d", 1, 1, "p"), ("a", None, None, 2, 2, None), (None, "k", "d", 3, 3, "p"), ("b", "k", "d", 4, 4, "q"), ("b", "k", "dd", 5, 4, "q")]
    f = spark.createDataFrame(rows, "name string, kind string, description string, chunk long, at long, path string")
    got = sorted(tuple(r) for r in M.merge_nodes(f).select("name", "kind", "descriptions", "sources", "n_sources", "paths").collect())
    assert got == [("a", None, ["d", None], [1, 2], 2, ["p"]), ("b", "k", ["dd", "d"], [4, 5], 2, ["q"])]
    assert "Join" not in planned(spark, lambda: M.merge_nodes(f))


def test_a_deletion_moves_verdicts_once(spark):
    """What tables follow from the verdicts is read from where they are stored; nothing is dealt out again for each."""
    ents = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 3), ("d", None)], "name string, chunk long")
    rels = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 2), ("b", "c", 3)], "src string, tgt string, chunk long")
    gone = spark.createDataFrame([(1,), (1,), (9,)], "chunk long")
    got = {(r.store, r.key, r.action) for r in B.delete_cascade(ents, rels, gone).collect() if "vector" not in r.store}
    assert got == {("entity", "a", "delete"), ("entity", "b", "rebuild"), ("entity", "c", "keep"), ("entity", "d", "keep"), ("relation", "a-b", "residual"), ("relation", "b-c", "keep"), ("entity chunks", "a", "delete"), ("relation chunks", "a-b", "delete")}
    assert "Exchange hashpartitioning" not in planned(spark, lambda: B.delete_cascade(ents, rels, gone))


def test_relations_are_rebuilt_in_few_exchanges(spark):
    """Weights, keywords and sources of a pair come from one grouping."""
    f = spark.createDataFrame([("a", "b", 1.0, "x", 1), ("a", "b", 2.0, "y", 1), ("a", "b", 4.0, "x", 2), ("a", "b", 8.0, "", 3), ("a", "c", 1.0, "", 1), ("b", "c", 1.0, "z", 7)], "src string, tgt string, weight double, keywords string, chunk long")
    e = spark.createDataFrame([("a", "b", 9.0, "old"), ("a", "c", 9.0, "old"), ("b", "c", 9.0, "old")], "src string, tgt string, weight double, keywords string")
    w = spark.createDataFrame([("a", "b", [1, 1, 3]), ("a", "c", [1]), ("b", "c", [])], "src string, tgt string, sources array<long>")
    got = sorted(tuple(r) for r in B.rebuild_edges(f, e, w).select("src", "tgt", "weight", "keywords", "n_sources", "how").collect())
    assert got == [("a", "b", 11.0, "x, y", 2, "fragments"), ("a", "c", 1.0, "old", 1, "fragments"), ("b", "c", 9.0, "old", 0, "current")]
    assert planned(spark, lambda: B.rebuild_edges(f, e, w)).count("Exchange hashpartitioning") <= 5


def test_postings_are_written_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """As many files as the texts have words, however small they are where they come from."""
    monkeypatch.setattr(L, "PART_WORDS", 100)
    docs = spark.createDataFrame([(i, ["all", "most", f"w{i % 7}", "all"]) for i in range(600)], "id long, terms array<string>")
    ix = L.save(L.index(docs, buckets=4), f"file://{tmp_path}/ix")
    ask = spark.createDataFrame([("all",), ("w3",)], "term string")
    sizes = [r.n for r in ix.postings.groupBy(F.input_file_name()).agg(F.count("id").alias("n")).collect()]
    assert sum(sizes) == 1800 and max(sizes) < 400
    assert L.top_k(ix, ask, 5).collect() == L.top_k(L.index(docs, buckets=4), ask, 5).collect()


def test_triangles_of_many_edges_are_not_dealt_to_ever_more_colours(spark, monkeypatch):
    """Beyond a few colours lists of neighbours are compared; marks that coincide make no triangle."""
    r = random.Random(2)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(300)} | {(0, i) for i in range(1, 40)})
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, tgt string")
    want = {x.node: x.triangles for x in T.triangles(edges).collect()}
    monkeypatch.setattr(T, "_by_colours", None)
    assert {x.node: x.triangles for x in T.triangles(edges, 10).collect()} == want
    monkeypatch.setattr(T, "_mark", lambda v: (v % 3).cast("short"))
    assert {x.node: x.triangles for x in T.triangles(edges, 10).collect()} == want


def test_segments_are_written_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """A bucket's postings are as many files as its words ask for, not one up to a million documents."""
    monkeypatch.setattr(L, "PART_WORDS", 400)
    monkeypatch.setattr(S, "BLOCK", 8)
    docs = spark.createDataFrame([(i, ["all"] * (i % 3 + 1) + ["most", f"w{i % 7}"]) for i in range(600)], "id long, terms array<string>")
    ix = S.SegmentedIndex.create(spark, f"file://{tmp_path}/ix", docs, buckets=2)
    posts = ix.view().postings
    sizes = [r.n for r in posts.where("term = 'all'").groupBy(F.input_file_name()).agg(F.count("id").alias("n")).collect()]
    assert sum(sizes) == 600 and len(sizes) > 1 and posts.count() == 1800
    ix.delete(spark.createDataFrame([(5,), (7000,)], "id long"))
    assert ix.state().n == 599 and ix.view().postings.where("id = 5").count() == 0


def test_mixed_search_compares_vectors_twice(spark, sf_dir, monkeypatch):
    """Once for what is near and once for relations, whatever sections follow from them."""
    calls, scored = [], V.scored
    monkeypatch.setattr(V, "scored", lambda *a: calls.append(a) or scored(*a))
    assert registry.QUERIES["mix_search"](spark, sf_dir).count() > 0
    assert len(calls) == 2


def test_best_relations_are_sought_by_the_nearest_vectors(spark, tmp_path, monkeypatch):
    """Edges are joined with all vectors only where the nearest do not suffice: too few edges, or scores that are shared."""
    r = random.Random(5)
    vectors = [(i, [float(r.randint(1, 3)), 1.0], 0) for i in range(40)]
    items = [(r.randint(0, 30), r.randint(0, 9), "A") for _ in range(90)]
    sf = tables(spark, tmp_path, embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"), lineitem=spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_returnflag string"))
    joined, ids = [], GQ._relation_ids
    monkeypatch.setattr(GQ, "_relation_ids", lambda *a: joined.append(a) or ids(*a))
    rows = [tuple(x) for x in GQ._relation_scores(spark, sf).select("src", "tgt", "score").collect()]
    want = sorted(rows, key=lambda x: (-x[2], x[0], x[1]))[:15]
    for near, times in ((40, 2), (3, 2), (41, 1)):
        joined.clear()
        monkeypatch.setattr(GQ, "NEAR", near)
        assert [tuple(x) for x in GQ._best_relations(spark, sf, 15).orderBy("pos").select("src", "tgt", "score").collect()] == want
        assert len(joined) <= times


def test_keywords_of_edges_are_bits(spark, monkeypatch):
    """Few kinds are added up as bits, many as sets; neither counts what is missing."""
    li = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "b"), (1, 2, None), (2, 1, "ä"), (2, 1, "z"), (2, 1, None)], "l_partkey long, l_suppkey long, l_returnflag string")
    want = [("P1", "S1", 3.0, "a,b"), ("P1", "S2", 1.0, ""), ("P2", "S1", 3.0, "z,ä")]
    assert sorted(tuple(x) for x in D._edges(li).collect()) == want
    assert "ObjectHashAggregate" not in planned(spark, lambda: D._edges(li))
    monkeypatch.setattr(D, "BITS", 3)
    assert sorted(tuple(x) for x in D._edges(li).collect()) == want


def test_means_of_the_query_are_those_of_its_sql(spark, tmp_path):
    """At halves of the last place the order in which doubles are added up decides, so they are added up in order of events, wherever those stand."""
    r = random.Random(4)
    rows = [(i, i % 40, "view", r.randrange(60000) / 100) for i in range(40 * 64)]
    rows += [(9000 + i, 99, "error" if i == 1 else "view", v) for i, v in enumerate([0.5, 7.0, None, 1.5])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    sf = tables(spark, tmp_path, events=events)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet' ORDER BY event_id")
    found = con.execute(registry.ORACLE_SQL["rerank_aggregate"]).fetchall()
    want = sorted((doc, score, how, pos) for doc, score, how, pos in found)
    exact = L.rerank_aggregate(events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("value").alias("score")).where("doc <> 99"), "mean")
    assert {(x.doc, x.score) for x in exact.collect()} - {w[:2] for w in want if w[2] == "mean"}
    assert sorted((x.doc, x.score, x.how, x.pos) for x in registry.QUERIES["rerank_aggregate"](spark, sf).collect()) == want
    turned = tables(spark, tmp_path / "turned", events=events.orderBy(F.desc("event_id")))
    assert sorted((x.doc, x.score, x.how, x.pos) for x in registry.QUERIES["rerank_aggregate"](spark, turned).collect()) == want
    odd = spark.createDataFrame([(1, 0, float("inf")), (2, 0, 1e300), (3, 0, -0.0000005), (4, 0, None)], "doc long, pos long, score double")
    assert {x.doc: x.score for x in L.rerank_aggregate(odd, "mean", exact=False).collect()} == {1: float("inf"), 2: 1e300, 3: -0.000001}
