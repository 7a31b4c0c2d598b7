"""N-gram Jaccard join by signature trees (operator 7).

Links are all pairs of texts whose sets of distinct word 5-grams have
``intersection / union >= 0.8``. No link is lost:

1. One pass over the texts makes each set and its class (exact copies of a
   set share one class, so a copied text is looked at once) and emits the
   set's first ``n - ceil(0.8 n) + 1 + n // 5`` shingles in hash order,
   packed by hash bucket. Two linked sets share at least ``1 + m // 5`` of
   these entries, m being the smaller size that a partner can have, so a
   class with fewer entries that others hold cannot link and goes.
2. By the same count, two linked sets still share an entry if each leaves out
   its commonest entries, all but one of those it must share. Classes that
   share one of the rest fall into blocks (components); passages that many
   unlike texts share make no block. Links never leave a block.
3. A block is compared by a dual walk over signature trees: a node holds the
   OR (and AND) of its members' token bitmaps and their size range, and a
   pair of nodes is dropped once the greatest possible overlap is too small.
   What survives is verified on the whole sets. Members already known to be
   in one component are not compared again.
4. Blocks beyond ``chunk`` members are walked chunk by chunk, then chunk by
   chunk against what is not yet joined, so no task holds a whole block.

A shingle and a class are 64-bit hashes. Null and blank texts have the empty
set: ``n_shingles`` 0, linked with nothing. Rows with a null id link through
their text but never name a component (it is null if no member has an id).
Repeated rows come out as often as they came in; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import drop, held_at, lean, mix, null_as_empty, possibly_in, rows_of, scratch, shared_dir, shingle_sets, sized, spent, stored
from sparkweft.llm.components import components

_FIRST = "kind int, key long, doc_id long, n long, cls long, bucket int, blob binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def least_overlap(n: int, percent: int) -> int:
    """Smallest intersection that a set of n shingles has with any partner."""
    return -(-n * percent // 100)


def class_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        at = np.arange(1, len(tokens) + 1, dtype=np.uint64)
        x = (mix(tokens ^ mix(at)) * (at | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(tokens))
        return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


#: Buckets at most: a bucket's number stays below 2^32 when multiplied by 32 bits of a hash.
MOST_BUCKETS = 1 << 20
#: Blocks of several chunks that may be broadcast: some 30 bytes each.
FEW_BLOCKS = 1_000_000
#: Entries beyond the first that any two linked sets share, as a divisor of the size.
SPARE = 5


def entry_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + 1 + n // SPARE)


def entries_needed(n: Column, percent: int) -> Column:
    """Entries that a set of n shingles shares with any partner, which has least_overlap(n) shingles or more."""
    return 1 + F.floor(F.ceil(n * percent / 100) / SPARE)


def _scan(k: int, percent: int, buckets: int, batch_docs: int = 4096, batch_tokens: int = 600_000):
    """Pass 1: kind 0 rows are documents, kind 1 packed entries, kind 2 entries already known to be shared."""

    def flush(tokens: list[np.ndarray], classes: list[int]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        t = np.concatenate(tokens)
        c = np.repeat(np.array(classes, np.int64), [len(x) for x in tokens])
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.append(first, len(t)))
        again = np.repeat(count > 1, count)
        rows = {"kind": [], "bucket": [], "blob": []}
        if again.any():
            rows["kind"].append(2)
            rows["bucket"].append(0)
            rows["blob"].append(np.stack([t[again].view(np.int64), c[again]]).tobytes())
        t1, c1, many = t[first], c[first], count > 1
        # The bucket is the top of the hash, so buckets are runs of the sorted tokens.
        b = (t1 >> np.uint64(32)).astype(np.int64) * buckets >> 32
        cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
            rows["kind"].append(1)
            rows["bucket"].append(int(b[lo]))
            rows["blob"].append(_pack(t1[lo:hi], c1[lo:hi], many[lo:hi]))
        n = len(rows["kind"])
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows["kind"], pa.int32()), none, none, none, none, pa.array(rows["bucket"], pa.int32()), pa.array(rows["blob"], pa.binary())], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        classes: list[int] = []
        held, seen = 0, set()
        for batch in batches:
            texts = rows_of(batch, "text")
            n, cls = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, s in shingle_sets(texts, k):
                n[i] = len(s)
                if not len(s):
                    continue
                cls[i] = c = class_of(s)
                if c in seen:
                    continue
                seen.add(c)
                tokens.append(s[: entry_length(len(s), percent)])
                classes.append(c)
                held += len(tokens[-1])
                if held >= batch_tokens or len(tokens) >= batch_docs:
                    yield from flush(tokens, classes)
                    tokens, classes, held, seen = [], [], 0, set()
            m = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), rows_of(batch, "key"), rows_of(batch, "doc_id"), pa.array(n), pa.array(cls), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=_ARROW)
        yield from flush(tokens, classes)

    return run


def _pack(t: np.ndarray, c: np.ndarray, many: np.ndarray) -> bytes:
    """Entries of one bucket: tokens, classes (by a list of the distinct ones where that is shorter), and whether each is already known to be shared."""
    kinds, idx = np.unique(c, return_inverse=True)
    idx = idx.astype(np.int32 if len(kinds) > 65_000 else np.uint16)
    told = kinds.tobytes() + idx.tobytes()
    listed = len(told) < c.nbytes
    return np.array([len(t), len(kinds) if listed else 0], np.int64).tobytes() + t.tobytes() + (told if listed else c.tobytes()) + np.packbits(many).tobytes()


def _unpack(blob: bytes):
    m, kinds = np.frombuffer(blob, np.int64, 2)
    at = 16
    t = np.frombuffer(blob, np.uint64, m, at)
    c = np.frombuffer(blob, np.int64, kinds or m, at := at + 8 * m)
    at += c.nbytes
    if kinds:
        idx = np.frombuffer(blob, np.int32 if kinds > 65_000 else np.uint16, m, at)
        c, at = c[idx], at + idx.nbytes
    many = np.unpackbits(np.frombuffer(blob, np.uint8, -(-m // 8), at), count=m).astype(bool)
    return t, c, many


_SHARED = pa.schema([("token", pa.int64()), ("cls", pa.int64())])


def _shared_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 2 blobs as rows."""
    for batch in batches:
        for blob in rows_of(batch, "blob").to_pylist():
            both = np.frombuffer(blob, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=_SHARED)


def _shared_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1 blobs, bucket by bucket: entries that two classes or more hold."""

    def close(parts: list) -> Iterator[pa.RecordBatch]:
        t, c, many = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, t))
        t, c, many = t[order], c[order], many[order]
        start = np.concatenate(([True], t[1:] != t[:-1]))
        run = np.cumsum(start) - 1
        other = np.concatenate(([False], (c[1:] != c[:-1]) & ~start[1:]))
        shared = (np.bincount(run, other) > 0) | (np.bincount(run, many) > 0)
        new = start | np.concatenate(([True], c[1:] != c[:-1]))
        keep = shared[run] & new
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(c[keep])], schema=_SHARED)

    now, parts = None, []
    for batch in batches:
        for bucket, blob in zip(rows_of(batch, "bucket").to_pylist(), rows_of(batch, "blob").to_pylist()):
            if bucket != now and parts:
                yield from close(parts)
                parts = []
            now = bucket
            parts.append(_unpack(blob))
    if parts:
        yield from close(parts)


class Tree:
    """Sets ordered by size and smallest token; levels of nodes over runs of them."""

    LEAF, FAN = 16, 8

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        low = np.array([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((low, np.floor(np.log(size) / np.log(1.25)).astype(int)))
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]

    def sign(self, bits: int) -> None:
        """Bitmaps of ``bits`` bits for all members and nodes."""
        m = len(self.sets)
        flat = np.zeros((m, bits), bool)
        for i, s in enumerate(self.sets):
            flat[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        self.bits = np.packbits(flat, axis=1).view(np.uint64)
        cuts = np.arange(0, m, self.LEAF)
        self.cuts = [cuts]
        self.nodes = [(np.bitwise_or.reduceat(self.bits, cuts), np.bitwise_and.reduceat(self.bits, cuts), np.minimum.reduceat(self.size, cuts), np.maximum.reduceat(self.size, cuts))]
        while len(cuts) > 1:
            up = np.arange(0, len(cuts), self.FAN)
            o, a, lo, hi = self.nodes[-1]
            self.nodes.append((np.bitwise_or.reduceat(o, up), np.bitwise_and.reduceat(a, up), np.minimum.reduceat(lo, up), np.maximum.reduceat(hi, up)))
            cuts = self.cuts[-1][up]
            self.cuts.append(cuts)

    def span(self, level: int, i: int) -> tuple[int, int]:
        cuts = self.cuts[level]
        return int(cuts[i]), int(cuts[i + 1]) if i + 1 < len(cuts) else len(self.sets)


def overlap_bound(size, must, may):
    """At most this many of a node's ``size`` tokens are in the other node: each bit set in all of its members and in none of the other's costs one."""
    return size[:, None] - np.bitwise_count(must[:, None, :] & ~may[None, :, :]).sum(axis=2, dtype=np.int64)


class Links:
    """Joins members of two trees (or of one with itself) that are similar enough."""

    def __init__(self, a: Tree, b: Tree, label_a: np.ndarray, label_b: np.ndarray, percent: int):
        self.a, self.b, self.percent = a, b, percent
        self.same = a is b
        self.la = label_a[a.order]
        self.lb = self.la if self.same else label_b[b.order]
        self.joined: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        x, y = sorted((int(self.la[i]), int(self.lb[j])))
        self.joined.append((y, x))
        self.la[self.la == y] = x
        if not self.same:
            self.lb[self.lb == y] = x

    def verify(self, i: int, j: int) -> bool:
        x, y = self.a.sets[i], self.b.sets[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int(np.count_nonzero(y[at] == x))
        return 100 * common >= self.percent * (len(x) + len(y) - common)

    def members(self, lo: int, hi: int, lo2: int, hi2: int) -> None:
        p, na, nb = self.percent, self.a.size[lo:hi], self.b.size[lo2:hi2]
        bound = np.minimum(overlap_bound(na, self.a.bits[lo:hi], self.b.bits[lo2:hi2]), overlap_bound(nb, self.b.bits[lo2:hi2], self.a.bits[lo:hi]).T)
        fit = bound * (100 + p) >= p * (na[:, None] + nb[None, :])
        for i, j in np.argwhere(fit).tolist():
            i, j = i + lo, j + lo2
            if (not self.same or i < j) and self.la[i] != self.lb[j] and self.verify(i, j):
                self.join(i, j)

    def walk(self) -> list[tuple[int, int]]:
        a, b, p = self.a, self.b, self.percent
        middle = float(np.median(np.concatenate((a.size, b.size))))
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * middle + 1)), 8, 14))
        a.sign(bits)
        if not self.same:
            b.sign(bits)
        elif len(a.sets) > 1:
            for i in range(len(a.sets) - 1):  # near copies mostly stand side by side
                if self.la[i] != self.la[i + 1] and self.verify(i, i + 1):
                    self.join(i, i + 1)
        stack = [(len(a.nodes) - 1, 0, len(b.nodes) - 1, 0)]
        while stack:
            la, i, lb, j = stack.pop()
            lo, hi = a.span(la, i)
            lo2, hi2 = b.span(lb, j)
            x, y = self.la[lo:hi], self.lb[lo2:hi2]
            if x.min() == x.max() == y.min() == y.max():
                continue
            if la == 0 and lb == 0:
                self.members(lo, hi, lo2, hi2)
                continue
            ra = range(i * Tree.FAN, min((i + 1) * Tree.FAN, len(a.cuts[la - 1]))) if la else range(i, i + 1)
            rb = range(j * Tree.FAN, min((j + 1) * Tree.FAN, len(b.cuts[lb - 1]))) if lb else range(j, j + 1)
            oa, na, loa, hia = (t[ra.start : ra.stop] for t in a.nodes[max(la - 1, 0)])
            ob, nb, lob, hib = (t[rb.start : rb.stop] for t in b.nodes[max(lb - 1, 0)])
            most = np.minimum(overlap_bound(hia, na, ob), overlap_bound(hib, nb, oa).T)
            # The partner of a set of s tokens has p/100 s to 100/p s; the least pair of both nodes needs p/(100+p) of its tokens in common.
            fit = (most * (100 + p) >= p * (loa[:, None] + lob[None, :])) & (hia[:, None] * 100 >= p * lob[None, :]) & (hib[None, :] * 100 >= p * loa[:, None])
            for r, s in np.argwhere(fit).tolist()[::-1]:
                if not self.same or (max(la - 1, 0), ra.start + r) <= (max(lb - 1, 0), rb.start + s):
                    stack.append((max(la - 1, 0), ra.start + r, max(lb - 1, 0), rb.start + s))
        return self.joined


def join_sets(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """Component label (the smallest label in it) of every set."""
    t = Tree(sets)
    links = Links(t, t, labels, labels, percent)
    links.walk()
    out = np.empty_like(labels)
    out[t.order] = links.la
    return out


def join_across(one: list[np.ndarray], two: list[np.ndarray], label1: np.ndarray, label2: np.ndarray, percent: int) -> list[tuple[int, int]]:
    return Links(Tree(one), Tree(two), label1, label2, percent).walk()


_SETS = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("cls", pa.int64()), ("tokens", pa.binary())])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = rows_of(batch, "cls").to_numpy()
            keep, blobs = [], []
            for i, s in shingle_sets(rows_of(batch, "text"), k):
                if len(s) and class_of(s) == cls[i]:
                    keep.append(i)
                    blobs.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rows_of(batch, "block").take(at), rows_of(batch, "chunk").take(at), rows_of(batch, "cls").take(at), pa.array(blobs, pa.binary())], schema=_SETS)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Runs of equal keys in rows sorted by them, as lists of row tuples."""
    now, rows = None, []
    for batch in batches:
        cols = [rows_of(batch, c).to_pylist() for c in batch.schema.names]
        at = [batch.schema.get_field_index(c) for c in keys]
        for row in zip(*cols):
            key = tuple(row[i] for i in at)
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


_LABELS = pa.schema([("block", pa.int64()), ("cls", pa.int64()), ("label", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _inside(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, _), rows in _groups(batches, ["block", "chunk"]):
            found = {r[2]: np.frombuffer(r[3], np.uint64) for r in rows}
            names = np.array(sorted(found), np.int64)
            labels = join_sets([found[c] for c in names.tolist()], names.copy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names), pa.array(labels)], schema=_LABELS)

    return run


def _across(percent: int):
    """Groups of columns (block, i, j, side, cls, label, tokens): side 0 against side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["block", "i", "j"]):
            sides = [{r[4]: (r[5], np.frombuffer(r[6], np.uint64)) for r in rows if r[3] == s} for s in (0, 1)]
            if all(sides):
                one, two = ([x[1] for x in s.values()] for s in sides)
                l1, l2 = (np.array([x[0] for x in s.values()], np.int64) for s in sides)
                if found := join_across(one, two, l1, l2, percent):
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGES)

    return run


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select(F.col("node").alias("label"), "root")
    return stored(labels.join(roots, "label", "left").select("block", "cls", F.coalesce("root", "label").alias("label")), "labels")


def _by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _large_blocks(sets: DataFrame, labels: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Blocks of several chunks: chunk 0 against the others, then whatever is still apart from its block's largest component against all."""
    on = ["block", "cls"]
    cols = ["block", "i", "j", "side", "cls", "label", "tokens"]
    rows = sets.join(labels, on).withColumn("count", F.col("chunks"))
    zero = rows.where("chunk = 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("count") - 1))).withColumn("side", F.lit(0))
    rest = rows.where("chunk > 0").withColumn("j", F.col("chunk")).withColumn("side", F.lit(1))
    pairs = zero.unionByName(rest).withColumn("i", F.lit(0)).select(*cols)
    edges = stored(_by(pairs, "block", "i", "j").mapInArrow(lean(_across(percent)), "u long, v long"), "links")
    labels = _relabel(labels, edges)
    # Ties go to the smallest label.
    top = labels.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("top"))
    rows = sets.join(labels, on).join(top, "block")
    loose = rows.where("label != top")
    many = loose.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("parts"))
    all_sides = rows.join(many, "block").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.col("chunk")).withColumn("side", F.lit(0)).select(*cols)
    loose_side = loose.join(many, "block").withColumn("j", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1)).select(*cols)
    edges = stored(_by(all_sides.unionByName(loose_side), "block", "i", "j").mapInArrow(lean(_across(percent)), "u long, v long"), "links")
    return _relabel(labels, edges)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, chunk: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs, size = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts")
    docs = null_as_empty(docs, "text")
    docs = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    buckets = min(max(32, size // (8 << 20)), MOST_BUCKETS)

    path = scratch(spark, "shingles")
    docs.mapInArrow(lean(_scan(k, percent, buckets)), _FIRST).write.partitionBy("kind").parquet(path)
    first = held_at(spark.read.schema(_FIRST).parquet(path), path)
    rows = first.where("kind = 0").select("key", "doc_id", "n", "cls")
    packed = first.where("kind = 1").select("bucket", "blob")
    known = first.where("kind = 2").select("blob")
    shared = known.mapInArrow(lean(_shared_here), "token long, cls long").union(_by(packed, "bucket").mapInArrow(lean(_shared_across), "token long, cls long"))
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.min("doc_id").alias("low"))
    need = classes.select("cls", entries_needed(F.col("n"), percent).alias("need"))
    # Dealt by class once: there repeated entries go, are counted, and meet what their class needs.
    own = Window.partitionBy("cls")
    held = shared.repartition("cls").distinct().withColumn("held", F.count(F.lit(1)).over(own))
    able = stored(held.join(need, "cls").where("held >= need").select("token", "cls", "need"), "able")
    for kind in (1, 2):
        drop(spark, f"{path}/kind={kind}")
    # In order of how many hold an entry, two linked sets still meet if each leaves out its need - 1 commonest entries.
    often = able.join(able.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "token")
    left = often.withColumn("held", F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy(F.desc("often"), F.desc("token")))).where("held >= need and nth >= need").select("token", "cls")
    left = stored(left, "entries")
    spent(able)
    roots = left.groupBy("token").agg(F.min("cls").alias("root"), F.max("cls").alias("top")).where("root < top").select("token", "root")
    edges = left.join(roots, "token").where("cls != root").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    blocks = components(edges)
    spent(left)

    # Blocks of several chunks are few; they are broadcast behind a check of their number, so that no block is gathered to be counted.
    large = stored(blocks.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks")).where("chunks > 1"), "large")
    counted = blocks.join(F.broadcast(large) if large.count() <= FEW_BLOCKS else large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    members = counted.select(F.col("node").alias("cls"), F.col("root").alias("block"), F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "chunks").join(classes.select("cls", "key"), "cls")
    members = stored(members, "members")

    def sets_of(some: DataFrame) -> DataFrame:
        some = some.select("key", "cls", "block", "chunk")
        texts = possibly_in(docs.select("key", "text"), "key", some).join(some, "key")
        return texts.mapInArrow(lean(_sets(k)), "block long, chunk long, cls long, tokens binary")

    labels = stored(_by(sets_of(members), "block", "chunk").mapInArrow(lean(_inside(percent)), "block long, cls long, label long"), "labels")
    if members.where("chunks > 1").limit(1).count():
        large = members.where("chunks > 1")
        parts = stored(sets_of(large).join(large.select("block", "cls", "chunks"), ["block", "cls"]), "sets")
        joined = _large_blocks(parts, labels.join(large.select("block", "cls"), ["block", "cls"], "left_semi"), percent, chunk)
        labels = labels.join(large.select("block", "cls"), ["block", "cls"], "left_anti").unionByName(joined)

    named = classes.select("cls", "low").join(labels.select("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    names = named.join(lows, "label").select("cls", "component_id")
    out = rows.where("n > 0").join(names, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
