from sparkweft.operators import hooks as H


def test_the_best_documents_are_taken_after_their_windows_are_joined(spark):
    """Document 1 has the three best windows; it is one place of the two all the same."""
    docs = spark.createDataFrame([(1, ["x"] * 9), (2, ["x", "y", "y"]), (3, ["y"] * 6), (4, [])], "id long, terms array<string>")
    score = H.reranker(lambda q, texts: [t.split().count(q) / len(t.split()) for t in texts])
    run = lambda **how: [(r.doc, r.score, r.pos) for r in H.rerank_documents(docs, "x", score, 3, 0, **how).orderBy("pos").collect()]
    assert run(top_n=2) == [(1, 1.0, 1), (2, 0.333333, 2)]
    assert run() == [(1, 1.0, 1), (2, 0.333333, 2), (3, 0.0, 3)]
    assert run(how="mean", top_n=1) == [(1, 1.0, 1)]
