import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkweft.streaming import documents as S

T0 = dt.datetime(2024, 5, 1, 12)


def put(spark, inbox, name, rows):
    spark.createDataFrame([(d, k, a, None, e, T0 + dt.timedelta(minutes=m)) for d, k, a, e, m in rows], S.EVENTS).coalesce(1).write.parquet(f"{inbox}/{name}")


def work(orders):
    """Documents a* succeed, b* fail once, c* always fail, d* are silent once, e* are silent for good."""
    first = F.col("attempt") == 1
    kind = F.col("doc_id").substr(1, 1)
    silent = (kind == "e") | (kind == "d") & first
    fails = (kind == "c") | (kind == "b") & first
    return orders.where(~silent).select("doc_id", F.when(fails, "error").otherwise("done").alias("kind"), "attempt", F.when(~fails, F.length("doc_id").cast("long")).alias("n_chunks"), F.when(fails, F.lit("broken")).alias("error"), F.timestamp_millis(F.col("at_ms") + 60_000).alias("at"))


def feed(spark, inbox, step):
    if step == 0:
        names = [f"{c}{i}" for c in "abcde" for i in range(4)]
        put(spark, inbox, "first", [(n, "submit", None, None, 0) for n in names] + [("a0", "submit", None, None, 0), ("a1", "done", 7, None, 1), ("zz", "done", 1, None, 1), (None, "submit", None, None, 1), ("a2", "nonsense", 1, None, 1)])
    else:
        put(spark, inbox, f"tick{step}", [(None, "tick", None, None, 180 * step)])


def run(spark, at, disturb=None):
    """Four feeds; disturb: batch numbers at which the stream dies after all was written and before it is committed."""
    inbox, folder = f"{at}/inbox", f"{at}/state"
    left = set(disturb or ())

    def die(batch):
        if batch in left:
            left.discard(batch)
            raise RuntimeError("killed")

    for step in range(4):
        feed(spark, inbox, step)
        while True:
            try:
                S.settle(spark, inbox, folder, work, tries=3, patience_ms=600_000, on_batch=die)
                break
            except Exception as e:
                assert "killed" in str(e)
    assert not left
    return inbox, folder


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """A store of state for each partition costs most of a small batch's time."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    return run(spark, f"file://{tmp_path_factory.mktemp('calm')}")


def test_lifecycle(spark, undisturbed):
    got = {r.doc_id: tuple(r)[1:] for r in S.statuses(spark, undisturbed[1]).collect()}
    want = {}
    for i in range(4):
        want |= {f"a{i}": ("processed", 1, 2, None), f"b{i}": ("processed", 2, 2, None), f"c{i}": ("failed", 3, None, "broken"), f"d{i}": ("processed", 2, 2, None), f"e{i}": ("failed", 3, None, "no outcome in time")}
    assert got == want
    seqs = S.transitions(spark, undisturbed[1]).groupBy("doc_id").agg(F.count("seq").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m")).collect()
    assert all(r.n == r.d == r.m for r in seqs)


def test_killed_and_restarted(spark, undisturbed, tmp_path):
    _, folder = run(spark, f"file://{tmp_path}", disturb=(0, 3, 5))
    rows = lambda f: sorted(map(str, S.transitions(spark, f).collect()))
    assert rows(folder) == rows(undisturbed[1])


def test_documents_share_keys(spark, undisturbed, tmp_path):
    """All documents in two keys, with a timer each, move as each does by itself."""
    inbox, folder = f"file://{tmp_path}/inbox", f"file://{tmp_path}/state"
    for step in range(4):
        feed(spark, inbox, step)
        S.settle(spark, inbox, folder, work, tries=3, patience_ms=600_000, buckets=2)
    rows = lambda f: sorted(map(str, S.transitions(spark, f).collect()))
    assert rows(folder) == rows(undisturbed[1])
    feed(spark, inbox, 4)
    query = S.start(spark, inbox, folder, work, tries=3, patience_ms=600_000, buckets=2)
    query.awaitTermination()
    assert {s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]} == {2}


def test_failed_again_submitted(spark, undisturbed):
    """New tries for a failed document, none for a processed one."""
    inbox, folder = undisturbed
    put(spark, inbox, "again", [("c0", "submit", None, None, 900), ("a0", "submit", None, None, 900)])
    S.settle(spark, inbox, folder, work)
    got = {r.doc_id: (r.status, r.attempt) for r in S.statuses(spark, folder).where("doc_id in ('a0', 'c0')").collect()}
    assert got == {"a0": ("processed", 1), "c0": ("failed", 6)}


def test_nothing(spark, tmp_path):
    assert S.statuses(spark, f"file://{tmp_path}/none").count() == 0
