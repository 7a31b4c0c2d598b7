import random

import pytest
from pyspark.sql import functions as F

from sparkweft.operators.packing import pack_groups

SCHEMA = "name string, pos long, tokens long, part string, n long"


def fold(rows, budget):
    """(name, pos, part) by going through each name's rows in order."""
    names = {}
    for name, pos, tokens in rows:
        names.setdefault(name, []).append((pos is not None, pos or 0, max(tokens or 0, 0)))
    out = []
    for name, found in names.items():
        part, used, held = 0, 0, 0
        for known, pos, tokens in sorted(found):
            if held >= 2 and used + tokens > budget:
                part, used, held = part + 1, 0, 0
            used, held = used + tokens, held + 1
            out.append((name, pos if known else None, part))
    return out


def packed(spark, rows, budget, **kw):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return [tuple(r) for r in pack_groups(df, budget, **kw).select("name", "pos", "part").collect()]


key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_against_fold(spark, block):
    r = random.Random(block)
    rows = [(name, i, r.choice([0, 1, 5, 20, 130])) for name, many in (("a", 90), ("b", 1), ("c", 2), ("d", 3), ("e", 40)) for i in range(many)]
    rows += [("zero", i, 0) for i in range(30)] + [("long", i, 500) for i in range(31)]
    rows += [("ties", i // 3, r.randrange(60)) for i in range(24)] + [("again", 1, 50)] * 9
    rows += [(None, i, 50) for i in range(7)] + [("nulls", None, 40), ("nulls", None, 90), ("nulls", 1, None), ("nulls", 2, -5), ("nulls", 3, 100), ("nulls", 4, 1)]
    r.shuffle(rows)
    assert sorted(packed(spark, rows, 120, block=block), key=key) == sorted(fold(rows, 120), key=key)


def test_leaves_its_result_alone(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert len(packed(spark, [("a", i, 7) for i in range(50)], 20, block=8)) == 50
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["parts"]


def test_empty(spark):
    assert packed(spark, [], 10) == []


def test_long_name(spark):
    """A name of 1,000,000 rows beside short ones: every part is full, and as the fold has it."""
    tokens = (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).alias("tokens")
    df = spark.range(1_000_000).select(F.lit("hot").alias("name"), F.col("id").alias("pos"), tokens).unionByName(spark.range(300).select(F.concat(F.lit("n"), F.col("id") % 50).alias("name"), F.col("id").alias("pos"), tokens))
    rows = [tuple(r) for r in df.toPandas().itertuples(index=False)]
    got = pack_groups(df, 1200).toPandas()
    want = {(n, p): k for n, p, k in fold(rows, 1200)}
    assert len(got) == len(want) and all(want[n, p] == k for n, p, k in got[["name", "pos", "part"]].itertuples(index=False))
