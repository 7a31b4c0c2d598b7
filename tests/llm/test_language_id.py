import random

import numpy as np
import pytest

from sparkweft.llm.common import IntTable
from sparkweft.llm.language_id import PIECE, Parser, held_out, identify, keep_identified, suffix_automaton

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then the other things", "de": "der schnelle braune fuchs springt über den faulen hund und dann die anderen", "fr": "le renard brun rapide saute par dessus le chien paresseux et puis les autres"}


def brute_phrases(text, sample):
    fold = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    text, sample, n = fold(text), fold(sample), 0
    for lo in range(0, len(text), PIECE):
        piece, at = text[lo : lo + PIECE], 0
        n += 1
        while at < len(piece):
            size = 0
            while at + size < len(piece) and piece[at : at + size + 1] in sample:
                size += 1
            if size == 0:
                # A character that the sample lacks ends the phrase before it and leaves none open.
                n += 1
                at += 1
                continue
            at += size
            if at < len(piece) and piece[at] in sample:
                n += 1
    return n


def test_automaton():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    step = suffix_automaton(text)
    def holds(w):
        s = 0
        for c in w:
            if c not in step[s]:
                return False
            s = step[s][c]
        return True
    whole = {tuple(text[i:j]) for i in range(9) for j in range(i, 9)}
    r = random.Random(1)
    assert all(map(holds, whole))
    assert all(holds(w) == (tuple(w) in whole) for w in ([r.randrange(1, 4) for _ in range(r.randrange(1, 6))] for _ in range(300)))


@pytest.mark.parametrize("seed", range(3))
def test_parse(seed):
    r = random.Random(seed)
    p = Parser(SAMPLES)
    texts = ["".join(r.choice("the qüzß un d.éx") for _ in range(r.randrange(1, 900))) for _ in range(20)]
    rates = p.rates(texts, many=3)
    for k, name in enumerate(p.languages):
        for j, t in enumerate(texts):
            assert round(rates[k, j] * len(t)) == brute_phrases(t, SAMPLES[name])


def test_rows(spark):
    rows = [(i, SAMPLES[k], k, "x") for i, k in enumerate(list(SAMPLES) * 6)]
    rows += [(100, None, "en", ""), (101, "", "de", ""), (102, "12 34 !", "fr", ""), (104, "½ ² Ⅷ", "fr", ""), (103, "THE FOX", None, ""), (None, "der hund", None, ""), (0, "über den hund", "fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [tuple(r)[:4] for r in identify(df).collect()]
    assert len(got) == len(rows)
    by = {(r[0], r[2]) for r in got}
    assert {(100, "und"), (101, "und"), (102, "und"), (104, "und"), (103, "en"), (None, "de")} <= by
    assert all(0 <= r[3] <= 1 for r in got)
    assert {r[0] for r in keep_identified(df).collect()}.isdisjoint({100, 101, 102, 104})
    assert {r[2] for r in identify(df.withColumn("lang", df.lang.substr(9, 9).cast("string")).where("lang is null")).collect()} <= {"und"}
    assert identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert docs.where(held_out(docs.doc_id)).count() == len(got)


def test_table():
    r = np.random.default_rng(4)
    cells = np.unique(r.integers(0, 1 << 40, 5000))
    t = IntTable(cells, np.arange(len(cells), dtype=np.int32))
    asked = np.concatenate((cells, r.integers(0, 1 << 40, 5000)))
    to, found = t.find(asked)
    assert (found == np.isin(asked, cells)).all() and (cells[to[found]] == asked[found]).all()
    assert not IntTable(cells[:0], np.zeros(0, np.int32)).find(asked)[1].any()


def test_table_grows_with_the_sample_alone():
    """An alphabet of thousands of letters costs no more than its transitions."""
    text = "".join(chr(0x4E00 + i * 7919 % 9000) for i in range(9000))
    p = Parser({"zh": text, "en": SAMPLES["en"]})
    assert len(p.table.keys) <= 8 * 3 * len(text) and p.predict([text[100:300], "the lazy dog"])[0] == ["zh", "en"]


def test_long_text():
    p = Parser(SAMPLES)
    text = "der faule hund springt " * 50_000
    names, scores, rates = p.predict([text, text[:23_000], "1" * 10**6])
    assert names == ["de", "de", "und"] and abs(rates[0] - rates[1]) < 1e-3 and scores[2] == 0
