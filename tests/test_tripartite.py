"""Triangles over three kinds of nodes, in shares."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkweft.operators import triangles as G
from sparkweft.operators import tripartite as T
from sparkweft.plans import registry


def plain(rows):
    """(degree, triangles) of every node; nulls are one node, in no triangle."""
    ab, ac, bc = ({(r[i], r[j]) for r in rows} for i, j in ((0, 1), (0, 2), (1, 2)))
    out = {}

    def add(kind, key, degree, found):
        d, n = out.get((None, None) if key is None else (kind, key), (0, 0))
        out[(None, None) if key is None else (kind, key)] = (d + degree, n + found)

    for pairs, i, j in ((ab, 0, 1), (ac, 0, 2), (bc, 1, 2)):
        for u, v in pairs:
            add(i, u, 1, 0)
            add(j, v, 1, 0)
    for a, b in ab:
        for c in {c for x, c in ac if x == a} if None not in (a, b) else ():
            if c is not None and (b, c) in bc:
                add(0, a, 0, 1), add(1, b, 0, 1), add(2, c, 0, 1)
    return out


def trade(seed, n=500):
    """Rows that repeat, nodes on nearly all rows, nulls at every end, and keys that are negative or long."""
    r = random.Random(seed)
    rows = [(r.randrange(30), r.randrange(40) - 20, r.randrange(15)) for _ in range(n)]
    rows += [(7, r.randrange(40), r.randrange(15)) for _ in range(100)] + [(r.randrange(30), 3, 100 + i) for i in range(100)] + [(40 + i, 3, 7) for i in range(60)]
    rows += [(None, 1, 2), (1, None, 2), (1, 2, None), (None, None, 2), (None, 2, None), (1, None, None), (None, None, None), (2**62, 3, -(2**62)), (90, None, None), (91, 5, None), (92, None, 5)]
    return rows + rows[:200]


def told(df):
    return {(r.kind, r.key): (r.degree, r.triangles) for r in df.collect()}


@pytest.mark.parametrize("share", [10**6, 150, 20])
def test_counts(spark, monkeypatch, share):
    monkeypatch.setattr(T, "SHARE", share)
    rows = trade(share)
    df = spark.createDataFrame(rows, "a long, b long, c long")
    out = T.clustering(df, len(rows))
    assert told(out) == plain(rows)
    for r in out.collect():
        assert r.coefficient == (round(2 * r.triangles / (r.degree * (r.degree - 1)), 6) if r.degree > 1 else 0.0)
    # Rows that are fewer or more than was said change nothing but the shares.
    assert told(T.clustering(df, 3)) == plain(rows)
    assert T.clustering(df.limit(0), 0).count() == 0
    ints = df.where("a < 100").selectExpr("int(a) AS a", "int(b) AS b", "int(c) AS c")
    assert told(T.clustering(ints, 900)) == plain([tuple(r) for r in ints.collect()])


@pytest.mark.parametrize(("rows_at_once", "pairs", "longer"), [(7, 5, 4), (64, 1000, 0), (3, 2, 1), (10**6, 10**6, 10**6)])
def test_slices(spark, monkeypatch, rows_at_once, pairs, longer):
    """Edges that repeat where a slice ends count once, and either end's list may be walked along."""
    rows = [r for r in trade(longer) if None not in r]
    df, x, y = spark.createDataFrame(rows, "a long, b long, c long"), F.expr("int(pmod(a, 3))"), F.expr("int(pmod(b, 4))")
    shares, blocks = T._dealt(df, "x", x, 3, "y", "b", "a", y=y), T._dealt(df.select("b", "c"), "y", y, 4, "b", "c")
    for name, n in (("SLICE", rows_at_once), ("PAIRS", pairs), ("LONGER", longer)):
        monkeypatch.setattr(T, name, n)
    got = {}
    for run, n in ((T._share_counts(shares, blocks), 4), (T._block_counts(blocks), 5)):
        for batch in run(iter([pa.record_batch([pa.array(range(n))], names=["id"])])):
            for r in batch.to_pylist():
                d, t = got.get((r["kind"], r["key"]), (0, 0))
                got[r["kind"], r["key"]] = (d + r["degree"], t + r["triangles"])
    assert got == plain(rows)


def test_what_is_written_does_not_grow_with_shares(spark, monkeypatch):
    """Rows and pairs are written once, however many shares there are."""
    rows = [r for r in trade(1) if None not in r]
    df, spent, written = spark.createDataFrame(rows, "a long, b long, c long"), T.spent, []
    monkeypatch.setattr(T, "spent", lambda t: written.append(spark.read.parquet(t._stored_at).count()) or spent(t))
    for share in (10**6, 50):
        monkeypatch.setattr(T, "SHARE", share)
        T.clustering(df, len(rows))
    assert written == [len(rows)] * 4


def test_trade_moves_neither_lists_nor_colours(spark, tmp_path, monkeypatch):
    """The query and its SQL, with nulls, orders that are missing, and items of one order that repeat."""
    monkeypatch.setattr(G, "_triangles", None)
    monkeypatch.setattr(T, "SHARE", 100)
    r = random.Random(3)
    orders = [(i, r.choice([*range(20), None])) for i in range(100)]
    items = [(r.randrange(110), r.choice([*range(30), None]), r.choice([*range(8), None])) for _ in range(600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT node, degree, triangles, coefficient FROM ({registry.ORACLE_SQL['clustering_trade']})").fetchall()
    got = [tuple(x) for x in registry.QUERIES["clustering_trade"](spark, str(tmp_path)).select("node", "degree", "triangles", "coefficient").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
