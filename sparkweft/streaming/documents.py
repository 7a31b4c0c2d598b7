"""The life of documents as a stream: submitted, worked on, tried again, processed or failed.

Events come as Parquet files in folders below ``inbox``. Each document has
state: its status, how often it was tried, and when it is given up on for want
of an outcome. What the state machine decides comes out as
transitions; those to ``processing`` are orders, which ``work`` turns into
outcomes. Outcomes are events again: they are written to the inbox and met by a
later batch.

Every batch writes folders named by its number and replaces them, before its
number is committed. A batch that an accident cuts short is run again over the
same events from the same state, and leaves the same rows; an outcome of an
attempt that is over changes nothing. So a stream that was killed and started
again ends in the tables of one that was not.

A call of the state machine, with its frames and its requests for state, costs
far more than a document, so a key is a bucket of documents by a hash of their
ids: it keeps their states in one value and the earliest of their times in one
timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sparkweft.sources.store import exists

#: kind: submit, done, error, or tick, which only moves the clock. attempt: the order an outcome belongs to.
EVENTS = "doc_id string, kind string, attempt long, n_chunks long, error string, at timestamp"
TRANSITIONS = "doc_id string, seq long, attempt long, status string, n_chunks long, error string, at_ms long"
#: Events of equal time: outcomes before new submissions.
ORDER = {"done": 0, "error": 1, "submit": 2}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """The states of a bucket's documents. tries: attempts since one was last submitted; due: when it is given up on, or 0."""

    def __init__(self, tries: int, patience_ms: int) -> None:
        self.most, self.patience = tries, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("documents", "timer long, documents array<struct<doc_id string, status string, seq long, attempt long, tries long, due long>>")

    def _read(self) -> tuple[int, dict[str, tuple]]:
        """(when the bucket's timer fires, its documents)."""
        timer, docs = self.state.get() if self.state.exists() else (0, [])
        return timer, {d[0]: tuple(d[1:]) for d in docs}

    def _write(self, timer: int, docs: dict[str, tuple]) -> None:
        first = min((d[4] for d in docs.values() if d[4]), default=0)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        self.state.update((first, [(k, *d) for k, d in docs.items()]))

    def _move(self, doc_id: str, old: tuple, status: str, tries: int, at: int, n_chunks: int | None = None, error: str | None = None) -> tuple[tuple, tuple]:
        """(new state, transition)."""
        _, seq, attempt, _, _ = old
        again = status == "processing"
        new = (status, seq + 1, attempt + again, tries, at + self.patience if again else 0)
        return new, (doc_id, new[1], new[2], status, n_chunks, error, at)

    def _lost(self, doc_id: str, old: tuple, at: int, error: str | None) -> tuple[tuple, tuple]:
        """An attempt came to nothing."""
        if old[3] < self.most:
            return self._move(doc_id, old, "processing", old[3] + 1, at, error=error)
        return self._move(doc_id, old, "failed", old[3], at, error=error)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in TRANSITIONS.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"seq": "int64", "attempt": "int64", "n_chunks": "Int64", "at_ms": "int64", "error": "object"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A document's new events: a few, for repeats are met once.
        events: dict[str, set] = {}
        for part in rows:
            for doc_id, at, kind, attempt, n, error in zip(part["doc_id"], part["at_ms"], part["kind"], part["attempt"], part["n_chunks"], part["error"]):
                if doc_id and kind in ORDER:
                    events.setdefault(doc_id, set()).add((int(at), ORDER[kind], kind, int(attempt), None if pd.isna(n) else int(n), error or None))
        timer, docs = self._read() if events else (0, {})
        out = []
        for doc_id, mine in events.items():
            now = docs.get(doc_id, ("", 0, 0, 0, 0))
            for at, _, kind, attempt, n_chunks, error in sorted(mine, key=lambda e: (*e[:4], e[4] is not None, e[4] or 0, e[5] or "")):
                told = None
                if kind == "submit" and now[0] in ("", "failed"):
                    told = self._move(doc_id, now, "processing", 1, at)
                elif now[0] == "processing" and attempt == now[2]:
                    if kind == "done":
                        told = self._move(doc_id, now, "processed", now[3], at, n_chunks=n_chunks)
                    elif kind == "error":
                        told = self._lost(doc_id, now, at, error)
                if told:
                    now, row = told
                    docs[doc_id] = now
                    out.append(row)
        if out:
            self._write(timer, docs)
            yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, docs = self._read()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        # A new attempt counts from what time it is by now, else its outcome would be late.
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for doc_id, old in docs.items():
            if old[4] and (old[4] == timer or old[4] < now):
                docs[doc_id], row = self._lost(doc_id, old, now, "no outcome in time")
                out.append(row)
        # The timer that fired is gone by itself.
        self._write(0, docs)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def start(spark: SparkSession, inbox: str, folder: str, work: Callable[[DataFrame], DataFrame], tries: int = 3, patience_ms: int = 600_000, late: str = "1 hour", buckets: int = 1024, on_batch: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """A query that follows the events below ``inbox`` and writes ``folder/transitions``.

    work: (orders: doc_id, attempt, at_ms) -> EVENTS of those that came to an
    end; an order without an outcome is tried again ``patience_ms`` after its
    time, as soon as events have moved the clock ``late`` beyond that. Rows
    without a document's id only move the clock; unknown kinds and outcomes of
    no open attempt change nothing; repeated events count once; a submission of
    a failed document gives it new tries, any other known one is ignored.
    buckets: how many keys share the documents, the same for the folder's life.
    A batch reads and writes the states of those it meets as a whole, so a
    stream of very many documents that come a few at a time wants more.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    events = spark.readStream.schema(EVENTS).parquet(f"{inbox}/*").where("at is not null").withWatermark("at", late)
    # Rows that only move the clock share the empty id, whose rows are read past.
    rows = events.select(F.when(F.col("kind") == "tick", "").otherwise(F.coalesce("doc_id", F.lit(""))).alias("doc_id"), "kind", F.coalesce("attempt", F.lit(0)).alias("attempt"), "n_chunks", F.coalesce("error", F.lit("")).alias("error"), F.unix_millis("at").alias("at_ms"), "at")
    told = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(Lifecycle(tries, patience_ms), TRANSITIONS, "Append", "EventTime")

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        here = f"{folder}/transitions/batch={batch_id}"
        batch.where("doc_id != ''").write.mode("overwrite").parquet(here)
        orders = session.read.schema(TRANSITIONS).parquet(here).where("status = 'processing'").select("doc_id", "attempt", "at_ms")
        outcomes = work(orders).select(*(c.split()[0] for c in EVENTS.split(", ")))
        outcomes.write.mode("overwrite").parquet(f"{inbox}/outcomes-{batch_id}")
        if on_batch:
            on_batch(batch_id)

    return told.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """All transitions so far."""
    if not exists(spark, f"{folder}/transitions"):
        return spark.createDataFrame([], TRANSITIONS)
    return spark.read.schema(TRANSITIONS).parquet(f"{folder}/transitions/*")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, status, attempt, n_chunks, error): where each document stands."""
    last = F.max_by(F.struct("status", "attempt", "n_chunks", "error"), "seq").alias("s")
    return transitions(spark, folder).groupBy("doc_id").agg(last).select("doc_id", "s.*")


def settle(spark: SparkSession, inbox: str, folder: str, work: Callable[[DataFrame], DataFrame], rounds: int | None = None, **options) -> None:
    """Follow the events that are there, and the outcomes they lead to, until a run after the first gives no order, so that no outcome is left (or for so many runs)."""
    n, seen = 0, None
    while rounds is None or n < rounds:
        start(spark, inbox, folder, work, **options).awaitTermination()
        n, now = n + 1, transitions(spark, folder).where("status = 'processing'").count()
        if now == seen:
            return
        seen = now
