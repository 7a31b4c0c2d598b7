import random
import re
import time

from sparkweft.llm.license_scan import NOTICES, Scanner, digest, scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    at = [(i, k) for i in range(len(words)) for k, p in BASE.items() if words[i : i + len(p)] == p]
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))


TEXTS = [
    None, "", "MIT License", "the mit\n-license; Apache  License, Version 2.0 gnu general public license", "amit license mit licenses", "mit licence apache1license",
    "MIT License " * 400, "permission is hereby grunted free of chrge to any person obtaining a copy", "All rights reservd.", "É mit Éclicense k mİt license mit license", "general public public license",
]


def test_against_brute(spark):
    r = random.Random(5)
    bits = ["mit", "license", "apache", "general", "public", " ", "-", "\n", "é", "x1", "Licence", "MIT "]
    rows = list(enumerate(TEXTS + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(40))) for _ in range(200)])) + [(None, "mit license"), (1, "")]
    df = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, labels string")
    got = [tuple(x) for x in digest(scan(df)).collect()]
    assert sorted((x[:6] for x in got), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert all(0 <= x[7] <= 1 and set(x[5].split(",")) <= set(x[6].split(",")) | {""} for x in got)
    assert digest(scan(df.limit(0))).count() == 0


def test_fuzzy():
    s = Scanner(NOTICES)
    label = lambda t: {(NOTICES[i].label, e) for _, _, i, e in s.spans(t)}
    assert label("x permission is hereby grunted free of chrge to any person obtaining a copy y") == {("mit", 2)}
    assert label("all rights reservd") == {("reserved", 1)}
    assert label("mit licence") == {("mit", 1)}
    assert label("nothing of the kind") == set()


def test_words_that_go_on():
    s = Scanner(NOTICES)
    label = lambda t: {(NOTICES[i].label, e) for _, _, i, e in s.spans(t)}
    assert label("x mit licensed y") == label("mit licenses") == label("mit licensed") == {("mit", 1)}
    assert label("apache licensed") == {("apache", 1)}
    assert label("general public licenses") == {("gpl", 1)}
    assert label("mit licensed mit license mit licenses") == {("mit", 0), ("mit", 1)}
    assert label("mit licensedxx") == set()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def exhaustive(text):
    """All runs of whole words within a notice's edits, the best of those that overlap."""
    w, out = text.split(" ") if text else [], []
    starts = [len(" ".join(w[:i])) + (i > 0) for i in range(len(w))]
    for at, n in enumerate(NOTICES):
        runs = []
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                run = " ".join(w[i:j])
                if len(run) > len(n.text) + n.edits:
                    break
                if len(run) >= len(n.text) - n.edits and (d := distance(run, n.text)) <= n.edits:
                    runs.append((d, starts[i], starts[i] + len(run)))
        kept = []
        for d, a, b in sorted(runs):
            if all(b <= x or y <= a for x, y, _, _ in kept):
                kept.append((a, b, at, d))
        out += kept
    return sorted(out)


def test_against_all_runs():
    """No run within the budget is lost: notices with edits at every place, also at their borders, among words that look like them."""
    s, r = Scanner(NOTICES), random.Random(9)
    letters = "aeilmnst 1é"

    def damaged(text, k):
        c = list(text)
        for _ in range(k):
            i = r.choice([0, len(c), r.randrange(len(c) + 1)])
            what = r.randrange(3)
            c[i : i + (what > 0)] = [] if what == 2 else [r.choice(letters)]
        return "".join(c)

    near = 0
    for _ in range(400):
        parts = []
        for _ in range(r.randrange(1, 4)):
            n = r.choice(NOTICES)
            parts.append(damaged(n.text, r.randrange(0, n.edits + 2)))
            parts += r.choices(["mit", "license", "public", "x", "general", "reserved", "the"], k=r.randrange(3))
        text = " ".join(" ".join(parts).split())
        want = exhaustive(text)
        assert s.spans(text) == want, text
        near += sum(e > 0 for _, _, _, e in want)
    assert near > 200
    for t in ("mit licenses", "xmit license", "mit license1", "all rights reservedd", "general public licenses", "creative commons attributions"):
        assert [e for _, _, _, e in s.spans(t)] == [1] and s.spans(t) == exhaustive(t), t


def test_long_text():
    """Hits without end take time in proportion; each exact place is found."""
    s = Scanner(NOTICES)

    def took(n):
        t = time.process_time()
        assert len(s.spans("mit license " * n + "end")) == n
        return time.process_time() - t

    took(100)
    assert took(16_000) < 16 * took(2000) + 0.5
