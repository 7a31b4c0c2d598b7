import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.functions import text as T
from sparkweft.operators import analytics, chunking, extract, fusion, graph, hooks, lexical, merge, ranking, tables, vector
from sparkweft.sources import store
from sparkweft.sources.store import scratch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chars(c):
    return F.filter(F.split(c, ""), lambda x: x != "")


def test_window_goldens(spark):
    d = spark.createDataFrame([(1, "0123456789abcdefghijklmno"), (2, ""), (3, "abc")], "id long, content string").withColumn("terms", chars(F.col("content")))
    got = rows(chunking.token_windows(d, 10, 3, sep=""))
    assert got == [(1, 0, 10, "0123456789"), (1, 1, 10, "789abcdefg"), (1, 2, 10, "efghijklmn"), (1, 3, 4, "lmno"), (3, 0, 3, "abc")]
    assert rows(chunking.rerank_windows(d, 10, 3, sep=""))[:4] == [(1, 0, 10, "0123456789"), (1, 1, 10, "789abcdefg"), (1, 2, 10, "efghijklmn"), (1, 3, 4, "lmno")]
    assert rows(chunking.rerank_windows(d.where("id = 1"), 4, 9, sep=""))[-1][3] == "lmno"


def test_split_only(spark):
    d = spark.createDataFrame([(1, "aa\n\nbbbb\n\nc")], "id long, content string")
    assert [r[3] for r in rows(chunking.split_windows(d, "\n\n", 3, 1, tokenizer=chars, sep=""))] == ["aa", "bbb", "bb", "c"]
    assert [r[3] for r in rows(chunking.split_windows(d, "\n\n", 4, 1, only=True, tokenizer=chars))] == ["aa", "bbbb", "c"]
    with pytest.raises(Exception, match="more than 3 tokens"):
        chunking.split_windows(d, "\n\n", 3, 1, only=True, tokenizer=chars).collect()


def test_path_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, tgt string, weight double")
    assert rows(graph.degrees(e)) == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(graph.with_edge_degree(e, graph.degrees(e)).select("src", "edge_degree")) == [("a", 3), ("b", 3)]
    assert rows(graph.edges_batch(e, spark.createDataFrame([("b", "a"), ("x", "a")], "a string, b string"))) == [("b", "a", 1.0)]
    assert rows(graph.bfs(e, spark.createDataFrame([("a",)], "node string"), 5)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.components(e.unionByName(spark.createDataFrame([("x", "y", 1.0)], e.schema)))) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(graph.rename(e, spark.createDataFrame([("c", "a")], "old string, new string"))) == [("a", "b", 3.0)]
    assert rows(graph.clustering(e).select("node", "coefficient")) == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
    ring = e.unionByName(spark.createDataFrame([("a", "c", 1.0)], e.schema))
    assert rows(graph.clustering(ring).select("node", "triangles", "coefficient")) == [(x, 1, 1.0) for x in "abc"]


def test_special_names(spark):
    odd = ["it's", 'a "b"', "c\\d", "é中", "x<SEP>y"]
    e = spark.createDataFrame([(min(a, "m"), max(a, "m"), 1.0) for a in odd], "src string, tgt string, weight double")
    assert dict(rows(graph.degrees(e))) == {"m": 5} | {a: 1 for a in odd}


def test_lists(spark):
    d = spark.createDataFrame([([1, 2, 2, 3, 4], [2, 9], [3, 5])], "a array<int>, b array<int>, c array<int>")
    one = lambda c: d.select(c).first()[0]
    assert one(merge.union_ids(F.col("a"), F.col("b"))) == [1, 2, 3, 4, 9]
    assert one(merge.limit_ids(F.col("a"), 2)) == [3, 4] and one(merge.limit_ids(F.col("a"), 2, "KEEP")) == [1, 2] and one(merge.limit_ids(F.col("a"), 0)) == []
    assert one(merge.limit_ids(F.col("b"), 5)) == [2, 9]
    assert one(merge.subtract_ids(F.col("a"), F.col("c"))) == [1, 2, 2, 4]
    assert one(merge.incremental_ids(F.col("a"), F.col("b"), F.col("c"))) == [1, 3, 4, 5]


def test_polling_and_turns(spark):
    c = spark.createDataFrame([(1, i, f"a{i}") for i in range(1, 3)] + [(2, i, f"b{i}") for i in range(1, 9)] + [(3, 1, "c1")], "owner int, pos int, chunk string")
    got = rows(fusion.pick_polling(c, 4, 2))
    assert [r[2] for r in got] == ["a1", "a2", "b1", "b2", "b3", "b4", "b5", "b6", "c1"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos long, k string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "pos long, k string")
    assert [r[1] for r in rows(fusion.round_robin([a, b], ["k"]))] == ["x", "y", "z"]
    t = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "pos long, tokens long")
    assert [r.pos for r in fusion.prefix_budget(t, "tokens", 7).collect()] == [1]


def test_ivf_all_buckets_is_exact(spark, sf_dir):
    from sparkweft.plans import data

    v, q = data.vectors(spark, sf_dir), data.query_vector(spark, sf_dir)
    exact = rows(vector.top_k(v, q, 5).select("id", "score"))
    filed = vector.ivf_save(v, scratch(spark, "ivf"))
    assert rows(vector.ivf_top_k(filed, q, 5, probes=10, most=10).select("id", "score")) == exact
    path = scratch(spark, "ivf")
    built = vector.ivf_build(v.drop("bucket"), path, "now")
    assert built.centroids.count() <= 32 and built.size == v.count()
    assert rows(vector.ivf_top_k(built, q, 1, probes=8, most=8).select("id")) == rows(vector.top_k(v, q, 1).select("id"))
    # Few vectors are searched whole; a file of another state is refused.
    assert rows(vector.ivf_top_k(built, q, 5, probes=1, most=1, fewest=vector.FEWEST).select("id", "score")) == exact
    again = vector.ivf_load(spark, path, "now")
    assert rows(again.vectors.select("id", "bucket")) == rows(built.vectors.select("id", "bucket"))
    with pytest.raises(ValueError, match="stale"):
        vector.ivf_load(spark, path, "later")
    # Vectors lie in the bucket of the nearest mean, but for a few that the last round of k-means moved.
    c = {r.bucket: np.array(r.c) for r in built.centroids.collect()}
    off = [r for r in built.vectors.collect() if min(c, key=lambda b: float(np.linalg.norm(c[b] - r.v))) != r.bucket]
    assert len(off) <= 0.1 * built.size
    assert vector.bucket_count(100) == 32 and vector.bucket_count(10_000) == 100 and vector.bucket_count(10**7) == 256
    with pytest.raises(Exception, match="dimensions"):
        vector.check_dimension(v, 3).collect()


def test_rerank(spark):
    p = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (2, 0, 0.5), (3, 0, None)], "doc int, pos int, score double")
    pick = lambda how: {r.doc: r.score for r in lexical.rerank_aggregate(p, how).collect()}
    assert pick("max") == pick("nonsense") == {1: 0.9, 2: 0.5} and pick("mean") == {1: 0.55, 2: 0.5} and pick("first") == {1: 0.2, 2: 0.5}


def test_text(spark):
    d = spark.createDataFrame([('"Ａｌｐｈａ"', "/localcontext what", "m:k:h:i", "<think>x</think> yes", "A: 1.\n### References\n[1]", "&lt;a&gt;\x00 ")], "n string, q string, k string, t string, a string, c string")
    r = d.select(T.normal_name("n").alias("n"), T.mode_prefix("q").alias("q"), T.cache_key_parts("k").alias("k"), T.without_thoughts("t").alias("t"), T.answer_only("a").alias("a"), T.clean("c").alias("c"), T.split_marks("k", [":"]).alias("s")).first()
    assert r.n == "Alpha" and tuple(r.q) == ("local", True, "what") and tuple(r.k) == ("m", "k", "h:i") and r.t == "yes" and r.a == "A: 1." and r.c == "<a>" and r.s == ["m", "k", "h", "i"]
    q = spark.createDataFrame([("**- Question 1: Why?**\n- Question 2: How?",)], "q string")
    assert q.select(extract.questions(F.col("q")).alias("x")).first().x == ["Why?", "How?"]
    j = spark.createDataFrame([('say ```json\n{"a": [1,],}\n```',)], "j string")
    assert j.select(extract.judge_json(F.col("j")).alias("x")).first().x == '{"a": [1]}'


def test_tables(spark):
    assert {r.status: r.n for r in tables.status_counts(spark.createDataFrame([("failed",)], "status string"), True).collect()} == {"pending": 0, "processing": 0, "preprocessed": 0, "processed": 0, "failed": 1, "all": 1}
    d = spark.createDataFrame([(i, "pending") for i in range(30)], "doc_id int, status string")
    assert [r.doc_id for r in tables.page(d, 0, 3, "nothing", False).collect()] == list(range(10))
    s = spark.createDataFrame([("processed", False), ("processed", True), ("failed", False)], "s string, m boolean")
    assert [r[0] for r in s.select(tables.shown_status(F.col("s"), F.col("m"))).collect()] == ["preprocessed", "processed", "failed"]


def test_beam_stops_and_merge_strategies(spark):
    from sparkweft.operators import modes

    e = spark.createDataFrame([("a", "b", 10.0), ("b", "c", 10.0), ("a", "d", 1.0)], "src string, tgt string, weight double")
    e, q = graph.adjacency(e), spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    near = spark.createDataFrame([("b", [0.9, 0.19**0.5]), ("c", [0.9, 0.19**0.5]), ("d", [0.0, 1.0])], "name string, v array<double>")
    start = spark.createDataFrame([("a", 1.0)], "node string, score double")
    assert {r.node for r in modes.beam(e, near, q, start, hops=3).collect()} == {"a", "b"}
    assert {r.node for r in modes.beam(e, near, q, start, hops=3, stop=2.0).collect()} == {"a", "b", "c"}
    p = spark.createDataFrame([(1, "x, y"), (2, None), (3, "y,x"), (4, "x, y")], "pos int, v string")
    one = lambda s: p.agg(merge.merge_attribute(s, "v").alias("r")).first().r
    assert one("concatenate") == "x, y\n\ny,x\n\nx, y" and one("keep_last") == "x, y" and one("join_unique") == "x, y<SEP>y,x" and one("join_unique_comma") == "x,y"
    with pytest.raises(ValueError):
        merge.merge_attribute("other", "v")


def test_hooks(spark):
    d = spark.createDataFrame([("k1", "abc"), ("k2", "de")], "key string, prompt string")
    assert [r[0] for r in d.select(hooks.embedding(lambda t: [[len(x), 1.0] for x in t], 1)("prompt")).collect()] == [[3.0, 1.0], [2.0, 1.0]]
    assert [r[0] for r in d.select(hooks.reranker(lambda q, t: [float(len(x)) for x in t])("key", "prompt")).collect()] == [3.0, 2.0]
    known = spark.createDataFrame([("k1", "old")], "key string, return string")
    assert rows(hooks.cached(d, known, hooks.completion(lambda p: [x.upper() for x in p]))) == [("k1", "old", False), ("k2", "DE", True)]


def test_overlap(spark):
    d = spark.createDataFrame([(["a", "b"], ["b", "c", "b"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(analytics.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_lexical_index(spark):
    """A saved index gives what one in memory gives, reads the buckets of its words alone, and is refused once it is stale."""
    d = spark.createDataFrame([(i, [f"w{(i * j) % 17}" for j in range(1, 9)]) for i in range(60)], "id long, terms array<string>")
    ask = spark.createDataFrame([("w1",), ("w5",), ("w5",), ("none",)], "term string")
    path = scratch(spark, "bm25")
    memory, saved = lexical.index(d), lexical.save(lexical.index(d), path, "one")
    want = rows(lexical.top_k(memory, ask, 7))
    assert len(want) == 7 and rows(lexical.top_k(saved, ask, 7)) == want == rows(lexical.top_k(lexical.load(spark, path, "one"), ask, 7))
    plan = lexical.top_k(saved, ask, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    with pytest.raises(ValueError, match="stale"):
        lexical.load(spark, path, "two")
    two = spark.createDataFrame([(1, "w1"), (1, "w5"), (1, "w5"), (2, "w3")], "kw int, term string")
    each = rows(lexical.top_each(saved, two, 7))
    assert [r[1:] for r in each if r[0] == 1] == want and {r[0] for r in each} == {1, 2}


def test_numbers_over_ranges(spark):
    d = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), (F.col("id") % 7).alias("n")).repartition(9)
    got = {r.k: r.pos for r in ranking.numbered(d, F.desc("k")).collect()}
    assert got == {k: 500 - k for k in range(500)}
    n = {r.k: r.n for r in d.collect()}
    assert {r.k: r.used for r in ranking.running(d, "n", "k").collect()} == {k: sum(n[i] for i in range(k + 1)) for k in range(500)}
    assert ranking.numbered(d.limit(0), "k").count() == 0


def test_kept_until_the_files_change(spark, tmp_path):
    made = []
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)

    def make(to):
        made.append(to)
        return store.stored_at(spark.read.parquet(path), to)

    ask = lambda: store.kept(spark, "t", [spark.read.parquet(path)], make).count()
    assert ask() == ask() == 10 and len(made) == 1
    spark.range(20).write.mode("overwrite").parquet(path)
    assert ask() == ask() == 20 and len(made) == 2
    # What someone deleted is made again.
    store.spent(store.kept(spark, "t", [spark.read.parquet(path)], make))
    assert ask() == 20 and len(made) == 3


def test_components(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(70)] + [("hub", f"m{i}") for i in range(50)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "src string, tgt string, weight double")
    assert {x.node: x.component for x in graph.components(df).collect()} == {x: find(x) for x in up}
