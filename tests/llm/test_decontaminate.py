import random
import re

import numpy as np

from sparkweft.llm.decontaminate import UNITS, WINDOW, clean, ends_of_runs, occurrences

KIND = "doc_id long, text string, item_id string"


def canonical(text):
    """Plain version: (template word, value, is a slot) of every word."""
    out = []
    for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or ""):
        w, before = m[0], (text[: m.start()]).rstrip(" \t'(*_-")
        low = "".join(c.lower() if c < "Ā" else c for c in w)
        if w[0].isdigit() and w[0].isascii():
            out.append(("<number>", low, True))
        elif low in UNITS and out and out[-1][0] == "<number>":
            out.append(("<unit>", low, True))
        elif (w[0].isupper() and w[0] < "Ā") and before and before[-1] not in ".!?\n\r:;\"":
            out.append(("<name>", low, True))
        else:
            out.append((low, low, False))
    return out


def key(window):
    """What a window is compared by: its template, or its values if all are slots."""
    return [(k, w[1]) for k, w in enumerate(window)] if all(w[2] for w in window) else [w[0] for w in window]


def brute(docs, items):
    found = set()
    for d, t in docs:
        a = canonical(t)
        for i, q in items:
            b = canonical(q)
            if not b or not a:
                continue
            if len(b) < WINDOW or len(a) < WINDOW:
                pairs = [(0, 0)] if key(a) == key(b) and len(a) < WINDOW else []
                size = len(b)
            else:
                pairs = [(x, y) for x in range(len(a) - WINDOW + 1) for y in range(len(b) - WINDOW + 1) if key(a[x : x + WINDOW]) == key(b[y : y + WINDOW])]
                size = WINDOW
            lines = {}
            for x, y in pairs:
                lines.setdefault(x - y, []).append((x, y))
            for hits in lines.values():
                slots = {(b[y + k][1], a[x + k][1]) for x, y in hits for k in range(size) if b[y + k][2]}
                ys = sorted({y for _, y in hits})
                run = len(ys) >= 6 and ys[-1] - ys[0] + 1 == len(ys)
                if len(slots) == len({s[0] for s in slots}) and (len(ys) / (max(0, len(b) - WINDOW) + 1) >= 0.5 or run):
                    found.add((d, i))
    return found


ITEM = "If Anna buys 12 apples for 3 dollars each and gives Ben 4 of them, how many dollars does Anna have left after paying 36 dollars?"
OTHER = ITEM.replace("Anna", "Carla").replace("12", "55").replace("dollars", "euros").replace("Ben", "Udo")
WRONG = ITEM.replace("does Anna", "does Zoe")


def test_cases(spark):
    docs = [(1, "Before. " + ITEM + " After that."), (2, "x y. " + OTHER), (3, "x. " + WRONG), (4, None), (5, ""), (6, "some clean text that has nothing to do with any of the questions at all"), (7, "short 7 question"), (None, ITEM), (1, "another text under the same id as the first of these rows"), (8, ITEM), (8, ITEM)]
    items = [(0, ITEM), (1, "short 9 question"), (2, ""), (3, None)]
    d = spark.createDataFrame([(*r, "z") for r in docs], KIND)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in occurrences(d, b).where("contaminated").collect()}
    assert got == brute(docs, items) == {(1, 0), (2, 0), (None, 0), (7, 1), (8, 0)}
    assert [r.consistent for r in occurrences(d, b).where("doc_id = 3").collect()] == [False]
    assert {r.doc_id for r in clean(d, b).collect()} == {1, 3, 4, 5, 6}
    assert occurrences(d.limit(0), b).count() == 0 and occurrences(d, b.limit(0)).count() == 0
    assert clean(d, b.limit(0)).count() == len(docs)


def test_against_brute(spark):
    r = random.Random(4)
    bank = ["the", "sum", "of", "Anna", "Ben", "3", "14", "km", "kg", "und", "Éva", "over.", "is", "train", "é,"]
    say = lambda n: " ".join(r.choice(bank) for _ in range(n))
    items = [(i, say(r.randrange(3, 25))) for i in range(12)]
    docs = [(i, say(r.randrange(0, 12)) + " " + (items[i % 12][1] if i % 3 else "") + " " + say(r.randrange(0, 12))) for i in range(60)]
    d, b = spark.createDataFrame([(*x, "z") for x in docs], KIND), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in occurrences(d, b).where("contaminated").collect()} == brute(docs, items)


def test_planted(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(x.item_id, x.text) for x in bench.collect()]
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    got = {(x.doc_id, x.item_id) for x in occurrences(docs, bench).where("contaminated").collect()}
    held = {(d, i) for d, t in rows for i, q in items if q in t}
    assert held <= got and {d for d, _ in got} == {d for d, _ in held}
    assert {x.doc_id for x in clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in got}


def independent(text, item, near=8):
    """The rule in words: a consistent run of 13 words, or half of the windows in consistent runs nearby. Works on word pairs, not on windows' hashes."""
    a, b = canonical(text), canonical(item)
    runs = []
    for d in range(-len(b), len(a)):
        y = 0
        while y < len(b):
            n = 0
            while y + n < len(b) and 0 <= y + n + d < len(a) and a[y + n + d][0] == b[y + n][0]:
                n += 1
            if n >= WINDOW:
                slots = {(b[y + k][1], a[y + k + d][1]) for k in range(n) if b[y + k][2]}
                if len(slots) == len({s[0] for s in slots}):
                    runs.append((d, range(y, y + n - WINDOW + 1)))
            y += max(n, 1)
    half = any(2 * len({w for e, r in runs if abs(e - d) <= near for w in r}) >= len(b) - WINDOW + 1 for d, _ in runs)
    return half or any(len(r) + WINDOW - 1 >= 13 for _, r in runs)


def test_runs(spark):
    w = [f"w{i}" for i in range(60)]
    gap = lambda *parts, fill="zz": f" {fill} ".join(" ".join(w[a:b]) for a, b in parts)
    holes = lambda *parts: " ".join(x if any(a <= i < b for a, b in parts) else f"q{i}" for i, x in enumerate(w))
    long = [x for x in w]
    long[2], long[40] = "Anna", "Anna"
    item = " ".join(long)
    wrong = lambda *parts: " ".join("Zoe" if i == 40 else x if any(a <= i < b for a, b in parts) else f"q{i}" for i, x in enumerate(long))
    texts = [
        holes((0, 20)), holes((0, 20), (30, 50)), holes((0, 12), (30, 42)), holes((0, 11), (15, 26), (29, 40), (45, 56)), gap((0, 12), (12, 24), (24, 36), (36, 48), (48, 60)),
        gap((0, 12), (20, 32)), wrong((0, 20), (30, 50)), wrong((30, 50)), " ".join(w) + " " + " ".join(w[:9]),
        gap((0, 12), (12, 24), (24, 36), (36, 48), (48, 60), fill="z " * 30), holes((0, 13)), holes((0, 12)),
    ]
    items = [(0, " ".join(w)), (1, item), (2, " ".join(w[:24]))]
    want = {(d, i) for d, t in enumerate(texts) for i, q in items if independent(t, q)}
    assert {(1, 0), (4, 2), (6, 1), (10, 0)} <= want and not {(2, 0), (5, 0), (9, 2), (11, 0)} & want
    d, b = spark.createDataFrame([(*x, "z") for x in enumerate(texts)], KIND), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in occurrences(d, b).where("contaminated").collect()} == want


def test_tables_of_numbers(spark):
    """Windows of numbers alone meet the same numbers only; a text that repeats a window on end yields few hits, and the item at its end is found."""
    numbers = " ".join(str(n * n % 97) for n in range(30))
    others = " ".join(str(n * 7 % 89) for n in range(3000))
    spam = "again and " * 3000
    item = "again and again and again and again and again and then the seventh of the brothers left his house and walked"
    docs = [(1, others), (2, "see " + numbers), (3, spam), (4, spam + item), (5, item + " " + spam), (6, "7 8 9"), (7, "word " * 5000), (8, "word " * 20)]
    items = [(0, numbers), (1, item), (2, "1 2 3"), (3, "word " * 12)]
    d, b = spark.createDataFrame([(*x, "z") for x in docs], KIND), spark.createDataFrame(items, "item_id long, text string")
    found = occurrences(d, b)
    assert {(x.doc_id, x.item_id) for x in found.where("contaminated").collect()} == {(2, 0), (4, 1), (5, 1), (7, 3), (8, 3)}
    # The first and last places of a run, not each of thousands.
    g, owner = np.array([5, 5, 5, 5, 5, 7, 7, 5, 5, 5], np.uint64), np.array([0] * 8 + [1] * 2)
    whole = np.array([True] * 4 + [False] + [True] * 5)
    assert ends_of_runs(np.ones(10, bool), g, np.ones(10, bool), owner, 2).tolist() == [True, True, False, True, True, True, True, True, True, True]
    assert ends_of_runs(np.ones(10, bool), g, whole, owner, 1).tolist() == [True, False, False, True, True, True, True, True, True, True]


def test_hot_window_and_long_text(spark):
    """One passage in most texts and a text of very many words."""
    docs = [(i, f"intro {i} " + ITEM) for i in range(300)] + [(999, "filler text " * 60_000 + OTHER)]
    d, b = spark.createDataFrame([(*x, "z") for x in docs], KIND), spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert {x.doc_id for x in occurrences(d, b).where("contaminated").collect()} == {i for i, _ in docs}
    assert clean(d, b).count() == 0
