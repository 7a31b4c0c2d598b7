import random

import numpy as np
import pytest

from sparkweft.llm.ngram_join import Tree, _pack, _unpack, join_sets, jaccard_components
from tests.llm import brute


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, block long")
    return sorted((tuple(r) for r in jaccard_components(df.repartition(3), **kw).collect()), key=str)


def near_copies(n, seed=1):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w[: r.randrange(90, 121)]))
    return out


def test_edge_rows(spark):
    rows = [(1, "a b c d e f", "", 1), (2, "A b\tc  d e f", "", 1), (3, None, None, None), (4, "", "", 0), (5, "one two", "", 0), (6, "ONE two", "", 0), (7, " \n", "", 0), (None, "one two", "", 0), (2, "a b c d e f", "", 1), (9, "é ß", "", 1)]
    assert run(spark, rows) == brute.jaccard_components([r[:2] for r in rows])
    assert run(spark, []) == []


def test_near_copies_in_chunks(spark):
    rows = [(i, t, "", 0) for i, t in enumerate(near_copies(60) + near_copies(30, 2))]
    want = brute.jaccard_components([r[:2] for r in rows])
    assert run(spark, rows) == want
    assert run(spark, rows, chunk=7) == want


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    assert got == brute.jaccard_components(rows)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("seed", range(4))
def test_tree_against_pairs(seed):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, r.integers(5, 200)).astype(np.uint64)
        for _ in range(r.integers(1, 6)):
            s = base.copy()
            cut = int(len(s) * r.choice([0, 0.05, 0.11, 0.2]))
            s[:cut] = r.integers(0, 2**63, cut).astype(np.uint64)
            sets.append(np.unique(s))
    labels = np.arange(len(sets))
    got = join_sets(sets, labels.copy(), 80)
    up = list(labels)
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert got.tolist() == [int(x) for x in up]
    assert len(Tree(sets).sets) == len(sets)


def test_packed_entries():
    """Packed entries come back, with few classes, with a class for each entry, and with none."""
    r = np.random.default_rng(5)
    for m, kinds in ((1000, 3), (1000, 10**9), (1, 1), (200_000, 10**9), (100_000, 70_000), (0, 1)):
        t, c, many = r.integers(0, 2**63, m).astype(np.uint64), r.integers(0, kinds, m), r.random(m) < 0.3
        blob = _pack(t, c, many)
        assert all((x == y).all() for x, y in zip(_unpack(blob), (t, c, many)))
        assert len(blob) <= 16 + 16 * m + m // 8 + 1


def test_hot_passage_and_long_text(spark):
    """One passage in most texts, hundreds of copies of one text, and texts of very many words."""
    r = random.Random(12)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    hot, long, copy = say(60), say(60_000), say(30)
    rows = [(i, f"{say(40)} {hot} {say(40)}", "", 0) for i in range(150)]
    rows += [(1000 + i, copy, "", 0) for i in range(300)] + [(2000, long, "", 0), (2001, long + " " + say(50), "", 0), (2002, say(50_000), "", 0), (2003, "again " * 50_000, "", 0), (2004, "again " * 9, "", 0)]
    rows += [(3000 + i, f"{hot} {say(3)}", "", 0) for i in range(40)]
    got = run(spark, rows, chunk=16)
    assert got == brute.jaccard_components([x[:2] for x in rows])
    assert {c for d, _, c in got if d in (2000, 2001)} == {2000} and {c for d, _, c in got if 1000 <= d < 2000} == {1000}
