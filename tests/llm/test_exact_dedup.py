import hashlib
import os
import random

import pytest
import xxhash

from sparkweft.llm import exact_dedup as D

KIND = "doc_id long, text string, n string, best string, rows string"


def plain(rows):
    of = {}
    for i, t in rows:
        of.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i))
    out = []
    for k, own in of.items():
        best = min(own)
        once = True
        for m in own:
            out.append((m[2], best[2], len(own), m == best and once, hashlib.sha256(k.encode()).hexdigest()))
            once = once and m != best
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "n", "b", "r") for i, t in rows], KIND).repartition(parts)


def got(spark, rows, parts=3, **how):
    out = D.classes(frame(spark, rows, parts), **how)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (5, "ab"), (6, "a b"), (7, "a b"), (8, "ab  "), (9, "AB"), (10, "é日x"), (11, "é 日 x"), (12, "\x85"), (None, "ab   "), (None, "zz"), (None, "zz"), (13, "q"), (13, "q"), (13, "q"), (14, "x" * 200_000), (15, "x" * 100_000 + " " + "x" * 100_000)]


def test_odd_rows(spark):
    assert got(spark, ODD) == plain(ODD)
    assert got(spark, []) == []


def test_ties_go_to_the_smallest_id(spark):
    rows = [(i, "a b c" if i % 2 else "ab c ") for i in range(20, 0, -1)]
    assert got(spark, rows, 5) == plain(rows)
    assert {r[1] for r in got(spark, rows)} == {1}


def test_full_tables_spill_and_recurse(spark, monkeypatch):
    """Tables of a few hundred bytes: pass 1 empties them, pass 2 spills and spills again; hot copies stand on most rows."""
    r = random.Random(2)
    rows = [(i, r.choice(["hot copy " * 8, f"text {r.randrange(60)} " * r.randrange(1, 9)])) for i in range(400)]
    assert got(spark, rows, 4, limit=700) == plain(rows)


@pytest.mark.parametrize("hash_of", [lambda c, seed: len(c) % 3, lambda c, seed: xxhash.xxh3_64_intdigest(c, seed) % 5])
def test_contents_of_one_hash_stay_apart(spark, hash_of):
    rows = [(i, f"{i % 17:02d}" + "abc"[i % 3] * (i % 5)) for i in range(300)]
    assert got(spark, rows, hash_of=hash_of) == plain(rows)


def test_grace(tmp_path):
    """A bucket larger than a table is taken file by file; no file is left, and every entry comes back once."""
    r = random.Random(3)
    records = [(str(r.randrange(500)).encode() * 9, [(i, i, 1, 1, i, 0)]) for i in range(3000)]
    found = list(D.grace(iter(records), f"file://{tmp_path}/s", limit=2000))
    assert len(found) == len({c for c, _ in found}) == len({c for c, _ in records})
    want = {}
    for c, own in records:
        want.setdefault(c, []).extend(own)
    assert {c: sorted(e) for c, e in found} == want
    assert os.listdir(tmp_path / "s") == []
    # One content beyond the table stays in memory: nothing could split it.
    big = [(b"x" * 5000, [(i, 0, 1, 1, i, 0)]) for i in range(4)]
    assert [(c, len(e)) for c, e in D.grace(iter(big), f"file://{tmp_path}/b", limit=2000)] == [(b"x" * 5000, 4)]
    assert not os.path.exists(tmp_path / "b")


def test_rows_that_stay(spark):
    df = frame(spark, ODD)
    out = D.deduplicate(df)
    assert out.columns == df.columns
    want = sorted((i, t) for i, t in {(r[0], t) for r, t in zip_kept(ODD)} if i is not None)
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((i, t) for i, t in rows if i is not None) == want
    assert [t for i, t in rows if i is None] == ["ab   ", "zz"] or [t for i, t in rows if i is None] == ["zz", "ab   "]


def zip_kept(rows):
    """(class row, text) of rows that stay."""
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    best = {}
    for i, t in rows:
        k = (-len(t or ""), i is None, i)
        if norm(t) not in best or k < best[norm(t)][0]:
            best[norm(t)] = (k, (i, t))
    return [((i,), t) for _, (i, t) in best.values()]
