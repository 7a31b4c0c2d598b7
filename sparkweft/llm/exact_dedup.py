"""Exact deduplication by Grace hashing (operator 12).

Texts are equal when they are identical without the blanks ``[\\x20\\x09-\\x0D]``.
Of equal texts the row of most code points stays, of those the one of smallest
``doc_id`` (rows without an id come last).

1. Each task of the input puts its texts into an open-addressing table that
   compares complete content. Once the table is full it is emptied: each
   content goes on once, with how often it stood there and its best row. Rows
   of contents that stood there more than once are kept aside under the
   content's place (task, number), so copies are combined before anything
   moves. All of it is written to the shared folder, so the places hold
   whatever a repeated task would make of them.
2. Contents are dealt by their hash. A task whose contents outgrow its table
   partitions them, by a hash of another seed, into spill files in the shared
   folder and takes those one by one, which may spill again, until each fits.
   Equal content always meets; unlike content of one hash is told apart byte
   by byte. A content's rows are not here, only one entry a place.
3. What a class is goes back to the rows by a join on the place. A place holds
   no more rows than one filling of a table, so no key of the join is hot.

Null texts count as empty, and all empty texts are one class. Rows that repeat
come out as often as they came in, one of them kept. An empty table gives an
empty result; other columns are ignored. ``deduplicate`` returns the rows that
stay, with all their columns.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import drop, file_bytes, lean, null_as_empty, open_fs, rows_of, scratch, spent, stored

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of content that a table holds before it is emptied, and the files it spills to.
TABLE_BYTES, FILES = 48 << 20, 16
#: Bytes of stored contents for a task of the second pass.
BUCKET_BYTES = 64 << 20
#: Rows that a task gives out at once.
OUT_ROWS = 8192

_PARTS = pa.schema([("kind", pa.int32()), ("task", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("best", pa.bool_()), ("n", pa.int64()), ("rows", pa.int64()), ("h", pa.int64()), ("content", pa.binary())])
_PARTS_SQL = "kind int, task long, place long, doc_id long, best boolean, n long, rows long, h long, content binary"
_FOUND = pa.schema([("task", pa.int64()), ("place", pa.int64()), ("rows", pa.int64()), ("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("winner", pa.bool_()), ("text_sha256", pa.string())])
_FOUND_SQL = "task long, place long, rows long, doc_id long, keep_id long, group_size long, winner boolean, text_sha256 string"
_SPILL = pa.schema([("content", pa.large_binary()), ("entries", pa.binary())])

Hash = Callable[[bytes, int], int]
#: Of a content in a place: (task, place, rows, code points and id of its best row, 1 if that has no id).
Entry = tuple[int, int, int, int, int, int]


class ContentTable:
    """Distinct contents in order of arrival, found by open addressing; equal means all bytes are."""

    def __init__(self, hash_of: Hash = xxhash.xxh3_64_intdigest, seed: int = 0):
        self.hash_of, self.seed = hash_of, seed
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask = array("q", [-1]) * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def place(self, content: bytes) -> int:
        """The number of a content; new ones get the next."""
        h = self.hash_of(content, self.seed)
        slots, at = self.slots, h & self.mask
        while (i := slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i
            at = (at + 1) & self.mask
        slots[at] = i = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.size += len(content) + 64
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return i

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = slots = array("q", [-1]) * (self.mask + 1)
        for i, h in enumerate(self.hashes):
            at = h & self.mask
            while slots[at] >= 0:
                at = (at + 1) & self.mask
            slots[at] = i


def _combine(limit: int, hash_of: Hash):
    """Pass 1: kind 0 rows are documents whose content repeats in its place, kind 1 contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        table, before = ContentTable(hash_of), 0
        members: list[list[tuple]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            held = 0
            for i, (content, own) in enumerate(zip(table.contents, members)):
                best = min(own)
                if len(own) > 1:
                    at = own.index(best)
                    rows += [(0, task, before + i, m[2], k == at, None, None, None, None) for k, m in enumerate(own)]
                h = table.hashes[i] & 0xFFFF_FFFF_FFFF_FFFF
                rows.append((1, task, before + i, best[2], None, -best[0], len(own), h - (1 << 64) if h >> 63 else h, content))
                held += len(content)
                if len(rows) >= OUT_ROWS or held > 4 << 20:
                    yield _batch(rows, _PARTS)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _PARTS)

        for batch in batches:
            texts = rows_of(batch, "text")
            ids, sizes = rows_of(batch, "doc_id").to_pylist(), pc.utf8_length(texts).to_pylist()
            for i, key, n in zip(range(len(texts)), ids, sizes):
                at = table.place(texts[i].as_buffer().to_pybytes().translate(None, BLANKS))
                if at == len(members):
                    members.append([])
                members[at].append((-n, key is None, key))
                if table.size > limit:
                    yield from flush()
                    before += len(members)
                    table.clear()
                    members = []
            if sum(map(len, members)) > 1 << 20:  # rows of few contents take room, too
                yield from flush()
                before += len(members)
                table.clear()
                members = []
        yield from flush()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Spill:
    """Files of contents and their entries, one for each part of a hash; read back once."""

    def __init__(self, folder: str):
        self.fs, at = open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.names = [f"{at}/{uuid.uuid4().hex}" for _ in range(FILES)]
        self.sinks: list = [None] * FILES
        self.writers: list = [None] * FILES

    def add(self, table: ContentTable, entries: list[list[Entry]]) -> None:
        dealt: list[list[int]] = [[] for _ in range(FILES)]
        for i, content in enumerate(table.contents):
            dealt[table.hash_of(content, table.seed + 1) % FILES].append(i)
        for f, own in enumerate(dealt):
            if not own:
                continue
            if self.writers[f] is None:
                self.sinks[f] = self.fs.open_output_stream(self.names[f])
                self.writers[f] = pa.ipc.new_stream(self.sinks[f], _SPILL, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.writers[f].write_batch(_batch([(table.contents[i], np.array(entries[i], np.int64).tobytes()) for i in own], _SPILL))

    def close(self) -> None:
        for w, s in zip(self.writers, self.sinks):
            if w is not None:
                w.close()
                s.close()

    def files(self) -> Iterator[Iterator[tuple[bytes, list[Entry]]]]:
        for name, w in zip(self.names, self.writers):
            if w is not None:
                yield self._read(name)
                self.fs.delete_file(name)

    def _read(self, name: str) -> Iterator[tuple[bytes, list[Entry]]]:
        with self.fs.open_input_stream(name) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                for content, raw in zip(batch.column(0), batch.column(1)):
                    yield content.as_py(), [tuple(e) for e in np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 6).tolist()]


def grace(records: Iterator[tuple[bytes, list[Entry]]], folder: str, limit: int = TABLE_BYTES, hash_of: Hash = xxhash.xxh3_64_intdigest, level: int = 0) -> Iterator[tuple[bytes, list[Entry]]]:
    """Each distinct content once, with the entries of all its records. A table holds ``limit`` bytes, or one content and what came after it."""
    table = ContentTable(hash_of, level)
    entries: list[list[Entry]] = []
    spill = None
    for content, own in records:
        at = table.place(content)
        if at == len(entries):
            entries.append([])
        entries[at] += own
        if table.size > limit and len(entries) > 1:
            spill = spill or Spill(folder)
            spill.add(table, entries)
            table.clear()
            entries = []
    if spill is None:
        yield from zip(table.contents, entries)
        return
    spill.add(table, entries)
    spill.close()
    table.clear()
    entries = []
    for own in spill.files():
        yield from grace(own, folder, limit, hash_of, level + 1)


def _resolve(folder: str, limit: int, hash_of: Hash):
    """Pass 2: a row for each place of each content, with what its class is."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[Entry]]]:
        for b in batches:
            cols = [rows_of(b, c).to_pylist() for c in ("task", "place", "rows", "n", "doc_id")]
            contents = b.column(b.schema.get_field_index("content"))
            for content, task, place, rows, n, key in zip(contents, *cols):
                yield content.as_py(), [(task, place, rows, n, key or 0, int(key is None))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/{uuid.uuid4().hex}"
        out: list[tuple] = []
        for content, entries in grace(records(batches), own, limit, hash_of):
            digest, total = hashlib.sha256(content).hexdigest(), sum(e[2] for e in entries)
            best = min(entries, key=lambda e: (-e[3], e[5], e[4], e[0], e[1]))
            keep = None if best[5] else best[4]
            for e in entries:
                out.append((e[0], e[1], e[2], None if e[5] else e[4], keep, total, e is best, digest))
                if len(out) >= OUT_ROWS:
                    yield _batch(out, _FOUND)
                    out = []
        if out:
            yield _batch(out, _FOUND)

    return run


def classes(docs: DataFrame, limit: int = TABLE_BYTES, bucket: int = BUCKET_BYTES, hash_of: Hash = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text")
    parts = stored(rows.mapInArrow(lean(_combine(limit, hash_of)), _PARTS_SQL), "places", compression="zstd")
    contents = parts.where("kind = 1").select("task", "place", "rows", "n", "doc_id", "h", "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(file_bytes(parts) or 0) // bucket))
    folder = scratch(spark, "spill")
    found = stored(contents.repartition(tasks, "h").drop("h").mapInArrow(lean(_resolve(folder, limit, hash_of)), _FOUND_SQL), "classes")
    drop(spark, folder)
    known = ["keep_id", "group_size"]
    single = found.where("rows = 1").select("doc_id", *known, F.col("winner").alias("kept"), "text_sha256")
    many = parts.where("kind = 0").select("task", "place", "doc_id", "best").join(found.where("rows > 1").drop("doc_id", "rows"), ["task", "place"])
    return single.unionByName(many.select("doc_id", *known, (F.col("best") & F.col("winner")).alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole. Of rows that repeat in id and text, the one whose other columns come first as JSON."""
    keys = {"__sha": F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", ""), 256), "__n": F.coalesce(F.length("text"), F.lit(0))}
    told = stored(classes(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of")), "kept")
    rows = docs.withColumns(keys)
    stay = rows.join(told, rows["doc_id"].eqNullSafe(told["__id"]) & (rows["__sha"] == told["__of"]), "left_semi")
    # Few ids stand on several rows of one text; those alone meet.
    often = stored(stay.groupBy("doc_id", "__sha").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select(F.col("doc_id").alias("__id"), F.col("__sha").alias("__of")), "repeated")
    on = rows["doc_id"].eqNullSafe(often["__id"]) & (rows["__sha"] == often["__of"])
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = stay.join(often, on, "left_semi").groupBy("doc_id", "__sha").agg(F.min_by(whole, F.struct(-F.col("__n"), F.to_json(whole))).alias("__row")).select("__row.*")
    return stay.join(often, on, "left_anti").select(*docs.columns).unionByName(first)
