"""Keyed tables that are written by deltas and merged when read.

A table lies in buckets by a hash of its key. Every write is a folder of its
own, a directory a bucket, and holds only what was written; nothing that is
there is touched. A manifest tells for each bucket which versions are alive,
oldest first; the first is whole (keys once, nothing deleted), the others are
deltas. (A bucket that begins with a delta has that one as its first.) A version counts once there is a manifest of its number, which only
one writer can make: a second writer of that number fails, and what it, or one
that died, has written is named by no manifest and read by nobody.

A read takes the buckets without deltas as they are. Of the others, rows of
keys that no delta names pass by, and the rest is merged by key. So the bulk
of the table is neither sorted nor shuffled; what moves is the deltas and the
rows they touch. ``compact`` merges the buckets whose deltas have grown, and
leaves the others where they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkweft.sources.manifest import Manifests

#: Keys of deltas up to this many go to every task of a read; beyond, they are shuffled.
FEW_KEYS = 1_000_000


@dataclass
class State:
    """What a manifest says: versions alive by bucket, and rows by version and bucket."""

    number: int
    buckets: int
    keys: list[str]
    schema: str
    first: list[str]
    fill: bool
    live: dict[int, list[int]] = field(default_factory=dict)
    rows: dict[int, dict[int, int]] = field(default_factory=dict)
    folders: dict[int, str] = field(default_factory=dict)

    def count(self, v: int, b: int) -> int:
        return self.rows.get(v, {}).get(b, 0)

    def deltas(self) -> set[int]:
        """Buckets that have some."""
        return {b for b, vs in self.live.items() if len(vs) > 1}


class KeyedTable:
    """A table of rows by key, which holds no null. ``first``: columns whose oldest value stays; ``fill``: a null leaves the older value."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Manifests(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = 16, first: tuple[str, ...] = (), fill: bool = False) -> KeyedTable:
        """A new table of ``rows``, whose keys stand once each and hold no null. Fails if there is one."""
        table = cls(spark, path)
        state = State(0, buckets, list(keys), rows.schema.json(), list(first), fill)
        table._commit(state, table._write(state, rows.withColumn("_gone", F.lit(False))), whole=True)
        return table

    # What there is

    def state(self) -> State:
        told = self.log.newest()
        told["live"] = {int(b): vs for b, vs in told["live"].items()}
        told["rows"] = {int(v): {int(b): n for b, n in of.items()} for v, of in told["rows"].items()}
        told["folders"] = {int(v): f for v, f in told["folders"].items()}
        return State(**told)

    def read(self, state: State | None = None) -> DataFrame:
        """All rows, merged."""
        state = state or self.state()
        return self._merged(state, sorted(state.live))

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys``, at most one each; only the buckets these fall into are read."""
        state = self.state()
        wanted = keys.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _kind(state) if f.name in state.keys]).distinct()
        there = wanted.select(self._bucket(state)).distinct().collect()  # no more rows than buckets
        return self._merged(state, sorted({r._bucket for r in there} & set(state.live))).join(wanted, state.keys, "left_semi")

    def _bucket(self, state: State) -> Column:
        known = F.lit(True)
        for k in state.keys:
            known &= F.col(k).isNotNull()
        h = F.pmod(F.xxhash64(*state.keys), F.lit(state.buckets)).cast("int")
        return F.when(known, h).otherwise(F.raise_error(F.lit("a key holds a null")).cast("int")).alias("_bucket")

    def _files(self, state: State, of: dict[int, list[int]]) -> DataFrame:
        """Rows of some buckets of some versions, with the version."""
        kind = _kind(state).add("_gone", "boolean").add("_bucket", "integer")
        out = None
        for v, buckets in sorted(of.items()):
            df = self.spark.read.schema(kind).parquet(f"{self.path}/{state.folders[v]}")
            if set(buckets) != set(state.rows[v]):
                df = df.where(F.col("_bucket").isin(sorted(buckets)))
            df = df.withColumn("_v", F.lit(v))
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.createDataFrame([], kind).withColumn("_v", F.lit(0))
        return out

    def _merged(self, state: State, buckets: list[int]) -> DataFrame:
        names = [f.name for f in _kind(state)]
        plain: dict[int, list[int]] = {}
        base: dict[int, list[int]] = {}
        news: dict[int, list[int]] = {}
        for b in buckets:
            vs = state.live[b]
            (plain if len(vs) == 1 else base).setdefault(vs[0], []).append(b)
            for v in vs[1:]:
                news.setdefault(v, []).append(b)
        out = self._files(state, plain).where("not _gone").select(*names)
        if not news:
            return out
        delta, old = self._files(state, news), self._files(state, base)
        touched = delta.select(*state.keys).distinct()
        if sum(state.count(v, b) for v, bs in news.items() for b in bs) <= FEW_KEYS:
            touched = F.broadcast(touched)
        rest = old.join(touched, state.keys, "left_anti").where("not _gone").select(*names)
        both = old.join(touched, state.keys, "left_semi").unionByName(delta)
        return out.unionByName(rest).unionByName(self._newest(state, both, names))

    def _newest(self, state: State, rows: DataFrame, names: list[str]) -> DataFrame:
        """A row a key out of all its versions; none where the last one deletes. What a deletion has ended is not taken up again."""
        ended = F.coalesce(F.max(F.when(F.col("_gone"), F.col("_v"))).over(Window.partitionBy(*state.keys)), F.lit(-1))
        alive = rows.withColumn("_end", ended).where(F.col("_v") > F.col("_end"))

        def one(c: str) -> Column:
            if c in state.first:
                return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c)
            at = F.when(F.col(c).isNotNull(), F.col("_v")) if state.fill else F.col("_v")
            return F.max_by(c, at).alias(c)

        return alive.groupBy(*state.keys).agg(*[one(c) for c in names if c not in state.keys]).select(*names)

    # What changes it

    def upsert(self, new: DataFrame, order: str | None = None) -> State:
        """Write ``new`` as a delta; of rows that share a key the last by ``order`` counts (by all columns, where none is given). Columns it lacks are null."""
        state = self.state()
        kind = _kind(state)
        full = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind], *([F.col(order).alias("_o")] if order else []))
        rest = [f.name for f in kind if f.name not in state.keys]
        by = F.struct(*(["_o"] if order else []), *rest) if rest or order else F.lit(0)
        last = full.groupBy(*state.keys).agg(F.max_by(F.struct(*rest), by).alias("_r")) if rest else full.select(*state.keys).distinct()
        last = last.select(*state.keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else last
        return self._commit(state, self._write(state, last.withColumn("_gone", F.lit(False))))

    def delete(self, gone: DataFrame) -> State:
        """Write a delta that ends the rows of ``gone``'s keys."""
        state = self.state()
        kind = _kind(state)
        keys = gone.select(*state.keys).distinct()
        rows = keys.select(*[(F.col(f.name) if f.name in state.keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind], F.lit(True).alias("_gone"))
        return self._commit(state, self._write(state, rows))

    def compact(self, share: float = 0.25, most: int = 8) -> list[int]:
        """Merge the buckets whose deltas hold over ``share`` of their first version's rows, or are over ``most``. The buckets it wrote."""
        state = self.state()
        grown = [b for b in sorted(state.deltas()) if len(state.live[b]) - 1 > most or sum(state.count(v, b) for v in state.live[b][1:]) > share * state.count(state.live[b][0], b)]
        if grown:
            self._commit(state, self._write(state, self._merged(state, grown).withColumn("_gone", F.lit(False))), whole=True, of=grown)
        return grown

    def vacuum(self) -> int:
        """Delete versions and manifests that the newest manifest doesn't name; returns how many versions. Nobody may be reading them."""
        state = self.state()
        return self.log.vacuum(state.number, set(state.folders.values()))

    def _write(self, state: State, rows: DataFrame) -> tuple[str, dict[int, int]]:
        """Rows in a folder that no manifest names yet, a file a bucket, and how many fell into each."""
        name = f"v{state.number + 1}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(state))
        dealt.repartition(state.buckets, "_bucket").sortWithinPartitions("_bucket", *state.keys).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        kind = _kind(state).add("_gone", "boolean").add("_bucket", "integer")
        told = self.spark.read.schema(kind).parquet(f"{self.path}/{name}").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        return name, {r._bucket: r.n for r in told}

    def _commit(self, before: State, written: tuple[str, dict[int, int]], whole: bool = False, of: list[int] | None = None) -> State:
        """Make the manifest that names what was written; whoever made one of this number first has won."""
        name, rows = written
        v = before.number + 1
        live = {b: list(vs) for b, vs in before.live.items()}
        for b in of or ():
            live.pop(b)  # a bucket that merged to nothing is gone
        for b in rows:
            live[b] = [v] if whole else [*live.get(b, []), v]
        alive = {x for vs in live.values() for x in vs}
        known = {x: n for x, n in {**before.rows, v: rows}.items() if x in alive}
        folders = {x: f for x, f in {**before.folders, v: name}.items() if x in alive}
        state = State(v, before.buckets, before.keys, before.schema, before.first, before.fill, live, known, folders)
        self.log.put(v, state.__dict__, name)
        return state


def _kind(state: State) -> StructType:
    return StructType.fromJson(json.loads(state.schema))
