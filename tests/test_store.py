"""Stores follow the files they were made of, and outlive the session that made them."""

import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkweft.operators import lexical as L
from sparkweft.operators import vector as V
from sparkweft.plans import data as D
from sparkweft.sources import store as S


def write(path, name, rows):
    """Uncompressed and without a dictionary, so that tables of alike rows have files of one size."""
    pq.write_table(pa.Table.from_pylist(rows), f"{path}/{name}.parquet", compression="none", use_dictionary=False, write_statistics=False)
    return os.path.getsize(f"{path}/{name}.parquet")


def docs(where):
    return [{"doc_id": i, "text": f"{'apple' if i == where else 'berry'} common words", "source": "s"} for i in range(4)]


def ask(spark, sf):
    return [r.id for r in L.top_k(D.chunk_index(spark, sf), spark.createDataFrame([("apple",)], "term string"), 5).collect()]


def test_words_of_a_rewritten_file(spark, tmp_path):
    sf = str(tmp_path)
    before = write(sf, "documents", docs(0))
    assert ask(spark, sf) == [0]
    assert write(sf, "documents", docs(1)) == before
    assert ask(spark, sf) == [1]


def test_vectors_of_a_rewritten_file(spark, tmp_path):
    sf = str(tmp_path)
    unit = lambda at: [1.0 if i == at else 0.0 for i in range(4)]
    rows = lambda at: [{"vec_id": i, "embedding": unit((i + at) % 4), "label": 0} for i in range(4)]
    q = spark.createDataFrame([(unit(0),)], "q array<double>")
    before = write(sf, "embeddings", rows(0))
    assert V.ivf_top_k(D.ivf(spark, sf), q, 1).first().id == 0
    assert write(sf, "embeddings", rows(1)) == before
    assert V.ivf_top_k(D.ivf(spark, sf), q, 1).first().id == 3


def test_edges_of_a_rewritten_file(spark, tmp_path):
    sf = str(tmp_path)
    rows = lambda to: [{"l_partkey": 1, "l_suppkey": to, "l_returnflag": "N"}]
    before = write(sf, "lineitem", rows(2))
    assert [r.tgt for r in D.edges(spark, sf).collect()] == ["S2"] and D.degrees(spark, sf).count() == 2
    assert write(sf, "lineitem", rows(3)) == before
    assert [r.tgt for r in D.edges(spark, sf).collect()] == ["S3"]
    assert {r.node for r in D.adjacency(spark, sf).collect()} == {r.node for r in D.degrees(spark, sf).collect()} == {"P1", "S3"}


def test_a_second_session_finds_the_store(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    write(sf, "documents", docs(2))
    assert ask(spark, sf) == [2]
    monkeypatch.setattr(S, "_open", {})
    monkeypatch.setattr(L, "save", lambda *a: pytest.fail("made again"))
    assert ask(spark, sf) == [2]


def test_old_states_go(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        S.stored_at(spark.range(len(made)), path)

    sf = str(tmp_path)
    for n in range(4):
        write(sf, "documents", docs(n))
        assert S.kept(spark, "some", [D.table(spark, sf, "documents")], make, lambda p: S.read_stored(spark, p)).count() == n + 1
    states = [d for d in os.listdir(folder(spark)) if d.startswith("some-")]
    assert len(states) == 1 and len(os.listdir(f"{folder(spark)}/{states[0]}")) == 2 and len(made) == 4
    # One that is gone is made again.
    for d in os.listdir(f"{folder(spark)}/{states[0]}"):
        shutil.rmtree(f"{folder(spark)}/{states[0]}/{d}")
    S.kept(spark, "some", [D.table(spark, sf, "documents")], make, lambda p: S.read_stored(spark, p))
    assert len(made) == 5


def folder(spark):
    return S.shared_folder(spark).removeprefix("file://") + "/stores"
