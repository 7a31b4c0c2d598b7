"""Renames move nodes, edges and vectors, and refuse names that are taken."""

import hashlib

import pytest

from sparkweft.operators import edits as E

ent = lambda n: "ent-" + hashlib.md5(n.encode()).hexdigest()
rel = lambda a, b: "rel-" + hashlib.md5("".join(sorted((a, b))).encode()).hexdigest()


def graph(spark):
    nodes = spark.createDataFrame([("a", None, "da"), ("b", "kb", None), ("c", "kc", "dc"), ("d", None, None)], "name string, kind string, description string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 4.0)], "src string, tgt string, weight double")
    vectors = spark.createDataFrame([(ent("a"), 1), (ent("b"), 2), (ent("c"), 3), (rel("a", "b"), 12), (rel("a", "c"), 13), (rel("b", "c"), 23)], "id string, v int")
    return nodes, edges, vectors


def run(spark, renames, **how):
    out = E.rename_entities(*graph(spark), spark.createDataFrame(renames, "old string, new string"), **how)
    return [sorted((tuple(r) for r in df.collect()), key=str) for df in out]


def test_rename(spark):
    nodes, edges, vectors = run(spark, [("a", "z"), ("nobody", "y")])
    assert nodes == [("b", "kb", None), ("c", "kc", "dc"), ("d", None, None), ("z", None, "da")]
    assert edges == [("b", "c", 4.0), ("b", "z", 1.0), ("c", "z", 2.0)]
    assert dict(vectors) == {ent("z"): 1, ent("b"): 2, ent("c"): 3, rel("z", "b"): 12, rel("z", "c"): 13, rel("b", "c"): 23}


def test_swapped_names(spark):
    nodes, edges, vectors = run(spark, [("a", "c"), ("c", "a")])
    assert nodes == [("a", "kc", "dc"), ("b", "kb", None), ("c", None, "da"), ("d", None, None)]
    assert edges == [("a", "b", 4.0), ("a", "c", 2.0), ("b", "c", 1.0)]
    assert dict(vectors) == {ent("c"): 1, ent("b"): 2, ent("a"): 3, rel("c", "b"): 12, rel("a", "c"): 13, rel("b", "a"): 23}


@pytest.mark.parametrize("renames", [[("a", "b")], [("a", "z"), ("b", "z")]])
def test_taken_names_are_refused(spark, renames):
    with pytest.raises(Exception, match="entity exists"):
        run(spark, renames)


def test_merge(spark):
    nodes, edges, vectors = run(spark, [("a", "b"), ("c", "b")], merge=True)
    assert nodes == [("b", "kb", "da"), ("d", None, None)]
    assert edges == [] and vectors == [(ent("b"), 2)]
