import math
import random
from collections import Counter

import numpy as np

from sparkweft.llm.quality import classify, discounts, learns, models, normal, train


def brute(texts, test, order):
    """Log probabilities of a text's characters by the textbook formulas."""
    count = Counter("".join(texts))
    known = {c for c, n in count.items() if n > 1}
    fold = lambda t: ["^"] * (order - 1) + [c if c in known else None for c in t]
    counts = [Counter(tuple(r[i - order + 1 : i + 1]) for r in map(fold, texts) for i in range(order - 1, len(r)))]
    for _ in range(order - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))
    counts.reverse()

    def p(n, g):
        if n == 0:
            return 1 / (len(known) + 1)
        c = counts[n - 1]
        d = discounts(np.array(list(c.values())))
        total = sum(v for k, v in c.items() if k[:-1] == g[:-1])
        if not total:
            return p(n - 1, g[1:])
        cut = sum(d[min(v, 3)] for k, v in c.items() if k[:-1] == g[:-1])
        return max(c[g] - d[min(c[g], 3)], 0) / total + cut / total * p(n - 1, g[1:])

    r = fold(test)
    return [math.log(p(order, tuple(r[i - order + 1 : i + 1]))) for i in range(order - 1, len(r))]


def test_model():
    r = random.Random(1)
    say = lambda n: "".join(r.choice("abc d") for _ in range(n))
    texts = [say(r.randrange(1, 30)) for _ in range(12)] + ["xy"]
    for order in (1, 2, 3, 5):
        m = train(texts, order)
        for t in [say(15), say(8), "xyab%%", "a"]:
            logs, text = m.log_probabilities([normal(t), normal("ab")])
            assert np.allclose(logs[text == 0], brute(texts, t, order), atol=1e-5), (order, t)
    total = sum(math.exp(brute(texts, f"ab{w}", 3)[-1]) for w in "abc d%")
    assert abs(total - 1) < 1e-6


def test_rows(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", "and", "dog"]) for _ in range(40))
    bad = lambda: " ".join(r.choice("@#$%") * 3 + str(r.random()) for _ in range(40))
    rows = [(i, good(), "en", 1.0) for i in range(60)] + [(i, bad(), "en", 1.0) for i in range(60, 80)] + [(90, None, "en", 0.0), (91, "", None, 0.0), (92, good(), None, 0.0), (93, good(), "xx", 0.0), (None, bad(), "en", 0.0), (1, good(), "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(60, 0, 0), (61, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = classify(df, labels).collect()
    assert len(got) == len(rows)
    assert {x.doc_id for x in got if x.keep} >= set(range(60)) | {92, 93}
    assert not any(x.keep for x in got if x.doc_id is None or 60 <= x.doc_id <= 91)
    assert not any(x.keep for x in classify(df, labels.limit(0)).collect())
    assert classify(df.limit(0), labels).count() == 0


def test_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([x.keep for x in got if x.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_whole_texts_teach(spark):
    r = random.Random(6)
    say = lambda n, bank: " ".join(r.choice(bank) for _ in range(n))
    words = ["the", "cat", "sat", "on", "a", "mat"]
    rows = [(i, say(8, words), "en") for i in range(2200)] + [(i, say(8, ["ein", "Haus", "und", "7"]), "de") for i in range(2200, 2230)]
    # A tail behind the first 4,000 characters, and more rows than 800.
    rows[:40] = [(i, say(1200, words) + " zebra quagga " * 20, "en") for i in range(40)]
    df = spark.createDataFrame([*rows, (None, "zzz", "en"), (3000, None, "en"), (3001, "", "de"), (3002, "no label", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(2230), 3000, 3001, None]], "doc_id long, quality int, toxic int")
    teach = {x.doc_id for x in df.where(learns(df.doc_id)).select("doc_id").collect()}
    got = models(df, labels, shard_rows=100)
    assert set(got) == {"en", "de"}
    for lang in got:
        mine = [t for i, t, g in rows if g == lang and i in teach]
        assert lang == "de" or len(mine) > 800
        want = train(mine)
        assert (want.names == got[lang].names).all()
        texts = [normal(t) for t in [*mine[:30], "zebra quagga", "the Haus %% cat", "unseen"]]
        assert np.allclose(got[lang].log_probabilities(texts)[0], want.log_probabilities(texts)[0], atol=1e-4)
    assert got["en"].log_probabilities([normal("zebra quagga")])[0][3:].mean() > -1
    assert models(df, labels.limit(0)) == {}
