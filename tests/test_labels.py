"""Label search through grams against a scan of all labels."""

import random

from sparkweft.operators import graph as G
from sparkweft.operators import labels as L


def test_rows_of_a_scan_from_few_files(spark, tmp_path):
    r = random.Random(4)
    words = ["Graph", "graph_store", "New York", "new", "york", "Ärzte", "ß", "a", "ab", "abc", "x_graph", "日本", "node"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice(["", str(r.randrange(500))]) for _ in range(600)} | {"graph", "zz unique label"})
    nodes = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "node string")
    ix = L.index(nodes, f"file://{tmp_path}/ix", buckets=24, parts=2)
    once = spark.createDataFrame([(n,) for n in names], "node string")
    for q in ("graph", " GRAPH ", "new york", "a", "ab", "ß", "日", "york 1", "unique", "nothing at all", "graph_store new", "ärz", "b", "%", "_"):
        found = L.search(spark, ix, q, 30)
        assert [tuple(x) for x in found.rows.collect()] == [tuple(x) for x in G.search_labels(once, q, 30).collect()], q
        assert found.read < found.files
    assert L.search(spark, ix, "unique label").read <= found.files // 2
    assert [tuple(x) for x in L.search(spark, ix, "", 5).rows.collect()] == [tuple(x) for x in G.search_labels(once, "", 5).collect()]
