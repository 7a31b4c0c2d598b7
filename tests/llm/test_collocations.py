import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sparkweft.llm import collocations as C
from tests.llm.brute import UPPER

KIND = "doc_id long, text string, lang string, m string, words string, phrase string"


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(rows, least=30, longest=4, percent=80, most=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(lang == x and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in found.items()):
            continue
        s, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:most]))


def got(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, t, l, "m", "w", "p") for i, (t, l) in enumerate(rows)], KIND).repartition(parts)
    out = C.collocations(df, **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def texts(n, seed, vocabulary=12):
    r = random.Random(seed)
    words = [r.choice("aäß日x") + str(i) for i in range(vocabulary)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(r.randrange(40)):
            t += r.choice(["new york city", "New York", *words]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;: ", " ", "\x85"])
        out.append((t, r.choice(["en", "de", None, ""])))
    return out


@pytest.mark.parametrize("least", [3, 30])
def test_against_plain(spark, least):
    rows = texts(300, 1)
    want = plain(rows, least)
    assert len(want) > (20 if least == 3 else 4)
    assert got(spark, rows, least=least) == want


def test_hot_pieces_ties_and_odd_rows(spark):
    rows = [("one two three four five", "en")] * 500 + [("a b. a b! A B", "en")] * 10 + [("b a", "en")] * 30 + [(None, "en"), ("", None), (" \t\n.,", "en"), ("word", "fr"), ("x y " * 30_000, None), ("z" * 50_000, "de")]
    want = plain(rows)
    assert got(spark, rows, 4) == want
    assert [w for w in want if w[0] == "en" and w[2] == "a b"]
    assert got(spark, []) == [] and got(spark, [("a b", "en")]) == []


def test_tasks_hand_on_often(spark, monkeypatch):
    """Little is held at once: several fillings a task, several blobs a bucket."""
    monkeypatch.setattr(C, "HELD", 50)
    monkeypatch.setattr(C, "AT_ONCE", 20)
    rows = texts(200, 5)
    assert got(spark, rows, least=5, most=7) == plain(rows, 5, most=7)


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "p", big), ("en", 1, "q", big), ("en", 2, "p q", big - 7)], "lang string, k int, phrase string, f long")
    r = C.scored(counts).first()
    assert r.score == 2000000 * (big - 7) // (2 * big)
    cands = spark.createDataFrame([("en", "p q", 2, big), ("en", "p q r", 3, big // 5 * 4), ("en", "q r", 2, big)], "lang string, phrase string, k int, a long")
    assert {r.phrase for r in C.uncovered(cands).collect()} == {"p q r"}
    cands = spark.createDataFrame([("en", "p q", 2, big), ("en", "p q r", 3, big // 5 * 4 - 1)], "lang string, phrase string, k int, a long")
    assert C.uncovered(cands).count() == 2


def test_pieces():
    rows = ["", " A  b,c\td ", "..", "e", "f\ng h  "]
    found, text, n = C.pieces_of(pa.array(rows))
    assert found.to_pylist() == ["a b", "c d", "e", "f", "g h"]
    assert text.tolist() == [1, 1, 3, 4, 4] and n.tolist() == [2, 2, 1, 1, 2]
