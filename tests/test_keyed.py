"""Merge-on-read tables against a plain dictionary, under random histories."""

import os
import random

import pytest

from sparkweft.sources.keyed import KeyedTable
from sparkweft.sources.manifest import Conflict

KIND = "k string, a long, b string, made long"


def rows(spark, some):
    return spark.createDataFrame(some, KIND)


def plain_upsert(table, new, fill):
    for k, a, b, made in new:
        old = table.get(k)
        if old is None:
            table[k] = (a, b, made)
        elif fill:
            table[k] = (old[0] if a is None else a, old[1] if b is None else b, made if old[2] is None else old[2])
        else:
            table[k] = (a, b, made if old[2] is None else old[2])


@pytest.mark.parametrize("fill", [False, True])
def test_random_histories(spark, tmp_path, fill):
    r = random.Random(7 + fill)
    one = lambda k, t: (k, r.choice([None, r.randrange(100)]), r.choice([None, "x", "y"]), t)
    keys = [f"k{i}" for i in range(60)]
    base = [one(k, 0) for k in keys[:40]]
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", rows(spark, base), ["k"], buckets=5, first=("made",), fill=fill)
    want = {}
    plain_upsert(want, base, fill)
    for t in range(1, 9):
        some = r.sample(keys, r.randrange(1, 12))
        what = r.choice(["upsert", "upsert", "delete", "compact"])
        if what == "upsert":
            new = [one(k, t) for k in some]
            table.upsert(rows(spark, new))
            plain_upsert(want, new, fill)
        elif what == "delete":
            table.delete(spark.createDataFrame([(k,) for k in some], "k string"))
            for k in some:
                want.pop(k, None)
        else:
            table.compact(share=0.1)
        if t % 3 == 0:
            assert {x.k: (x.a, x.b, x.made) for x in table.read().collect()} == want
    got = table.read().collect()
    assert len(got) == len(want) and {x.k: (x.a, x.b, x.made) for x in got} == want
    table.compact(share=0.0)
    table.vacuum()
    # Another handle reads the same.
    again = KeyedTable(spark, table.path)
    assert {x.k: (x.a, x.b, x.made) for x in again.read().collect()} == want
    assert all(len(v) == 1 for v in again.state().live.values())
    some = ["k1", "k5", "k59", "nobody"]
    assert {x.k for x in again.get(spark.createDataFrame([(k,) for k in some], "k string")).collect()} == set(some) & set(want)


def bytes_under(path):
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_delta_writes_its_own_rows_and_compaction_the_grown_buckets(spark, tmp_path):
    big = spark.range(50_000).selectExpr("cast(id as string) as k", "id as a", "repeat('b', 40) as b", "0L as made")
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", big, ["k"], buckets=16)
    before = bytes_under(tmp_path)
    table.upsert(rows(spark, [("7", 1, "new", 1), ("8", 2, "new", 1)]))
    added = {f: n for f, n in bytes_under(tmp_path).items() if f not in before}
    assert before.items() <= bytes_under(tmp_path).items()
    assert len(added) <= 2 and sum(added.values()) < sum(before.values()) / 20
    assert table.read().count() == 50_000 and table.get(spark.createDataFrame([("7",)], "k string")).first().b == "new"
    # A bucket's worth of deltas: that bucket is merged, the others keep their files.
    state = table.state()
    of = next(iter(state.deltas()))
    grown = big.withColumn("n", table._bucket(state)).where(f"n = {of}").drop("n").withColumn("a", big.a + 1)
    table.upsert(grown)
    assert table.compact() == [of]
    assert table.read().selectExpr("sum(a)").first()[0] == sum(range(50_000)) + grown.count() + outside(state, table, of)


def outside(state, table, of):
    """What the first delta changed and the second did not: keys 7 and 8 outside the grown bucket."""
    out = 0
    spark = table.spark
    for k, a in (("7", 1), ("8", 2)):
        b = spark.createDataFrame([(k,)], "k string").select(table._bucket(state)).first()._bucket
        if b != of:
            out += a - int(k)
    return out


def test_repeated_keys_and_missing_columns(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", rows(spark, []), ["k"], buckets=3)
    table.upsert(spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 3, 1)], "k string, a int, at int"), order="at")
    assert {(r.k, r.a, r.b) for r in table.read().collect()} == {("a", 1, None), ("b", 3, None)}
    table.delete(spark.createDataFrame([("zz",), ("a",)], "k string"))
    table.delete(spark.createDataFrame([("zz",), ("a",)], "k string"))
    assert [r.k for r in table.read().collect()] == ["b"]
    table.compact(share=0.0)
    assert [r.k for r in table.read().collect()] == ["b"]
    with pytest.raises(Exception, match="a key holds a null"):
        table.upsert(spark.createDataFrame([(None, 1)], "k string, a int"))


def test_one_writer_wins_and_a_dead_one_leaves_nothing(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", rows(spark, [("a", 1, "x", 0)]), ["k"], buckets=2)
    state = table.state()
    mine = table._write(state, rows(spark, [("a", 2, "mine", 1)]).selectExpr("*", "false as _gone"))
    table.upsert(rows(spark, [("a", 3, "theirs", 1)]))
    assert [r.b for r in table.read().collect()] == ["theirs"]
    with pytest.raises(Conflict):
        table._commit(state, mine)
    assert [r.b for r in table.read().collect()] == ["theirs"]
    # Data without a manifest, and a manifest cut short.
    table._write(table.state(), rows(spark, [("a", 9, "dead", 1)]).selectExpr("*", "false as _gone"))
    with open(f"{tmp_path}/t/log/{table.state().number + 1:012d}.json", "w") as f:
        f.write('{"number": 3, "buck')
    assert [r.b for r in table.read().collect()] == ["theirs"]
    assert table.vacuum() == 1
    table.upsert(rows(spark, [("c", 1, "z", 1)]))
    assert {r.k for r in table.read().collect()} == {"a", "c"}
