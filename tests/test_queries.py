"""Every registered query of the engine against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from sparkweft.plans import data, registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([told(r[c]) for c in cols] for r in df.collect())
    found = sql.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted([told(r[names.index(c)]) for c in cols] for r in found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_sql(spark):
    """The components of all edges, against a union-find; whatever else has no SQL is named here."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"components", "communities"}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in data.edges(spark, SF).select("src", "tgt").collect():
        a, b = find(r.src), find(r.tgt)
        up[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in registry.QUERIES["components"](spark, SF).collect()} == {x: find(x) for x in up}


def test_communities_of_the_nations(spark):
    """Every nation with an edge has one, named by its smallest member; no move of one nation would raise their modularity by much."""
    edges = data.nation_edges(spark, SF).collect()
    of = {r.node: r.community for r in registry.QUERIES["communities"](spark, SF).collect()}
    assert set(of) == {x for e in edges for x in (e.src, e.tgt)}
    assert all(c == min(x for x in of if of[x] == c) for c in of.values())
    two_m = 2 * sum(e.weight for e in edges)

    def q(of):
        k, inside = {}, 0
        for e in edges:
            for x in (e.src, e.tgt):
                k[of[x]] = k.get(of[x], 0) + e.weight
            inside += 2 * e.weight * (of[e.src] == of[e.tgt])
        return inside / two_m - sum((v / two_m) ** 2 for v in k.values())

    here = q(of)
    assert here > q({x: x for x in of}) and here >= q(dict.fromkeys(of, 0))
    assert max(q(of | {x: c}) for x in of for c in set(of.values())) < here + 0.02
