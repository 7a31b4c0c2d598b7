"""Token-id files with a minimal perfect hash index (operator 10).

Documents are dealt out by ranges of their id; each task encodes its range in
order and writes one shard: the raw ids, then an index, then a footer. The
index maps a document key through a minimal perfect hash to a slot, and the
slot to the rows of that key, their offsets in the payload and a fingerprint
that turns away keys the shard does not hold. A keyed read finds its shard in
the sorted list of ranges and then reads single cells of the index by their
offset: a bit and a rank for each level tried, the slot, the payload's place
and the ids; neither the index nor the list of keys is loaded for it. (The
list of keys in a shard serves those who list the shard.) A shard is written
under another name and renamed when it is whole, so a repeated task replaces
it.

Null and empty texts hold the end id alone. Rows without an id come first;
they are stored, but no key finds them. Rows that share an id stand side by
side, in order of their text, and one key finds them all. An empty table
gives no rows. Other columns are ignored.

Shard layout, little-endian: payload; keys int64[m]; row offsets uint64[m+1];
slots (fingerprint, first row, rows) uint32[d, 3]; for each level of the hash
its cells (64 bits, rank of the first) uint64[w, 2]; footer of uint64: number
of levels and words of each level (``LEVELS`` places), m, null rows, d, id
bytes, payload bytes, magic.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm.bpe import LETTER, NUMBER, PLAIN, Memo, byte_letters
from sparkweft.llm.common import lean, mix, null_as_empty, open_fs, qualified, rows_of, scratch, sized

MAGIC, LEVELS = 0x7366_7469_6473_3032, 40
#: Bytes of input files for a task and its shard, about.
SHARD_BYTES = 64 << 20
_WORD = re.compile(rf"[{LETTER}]+|[{NUMBER}]|'(?:[stmd]|re|ve|ll)|[^\s{LETTER}{NUMBER}]+")


class WordEncoder:
    """Whole texts to packed ids, as the library encodes them.

    Words of plain texts are encoded once by the library and remembered, up to
    a bound; any other text goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.letters = self.library.model, byte_letters()
        self.memo = Memo(self._word)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of a plain text in lower case: the library's model applied to its byte letters."""
        return np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            return b"".join(map(self.memo.__getitem__, _WORD.findall(text.lower())))
        return self._library(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03))


class PerfectHash:
    """Distinct int64 keys to 0..n-1. Level by level, keys that have a bit to themselves keep it; a key's slot is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            c = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(c) - c)
            total += int(c.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            words = max(1, -(-2 * len(left) // 64))
            at = (_hash(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where no level has a bit for it."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_hash(keys[todo], level) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[todo[hit]] = self.ranks[level][at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            todo = todo[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    def __init__(self, folder: str, name: str, kind: np.dtype, attempt: str):
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.temp, self.kind = f"{path}/{name}", f"{path}/.{name}.{attempt}", kind
        self.out = self.fs.open_output_stream(self.temp)
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.sizes.append(len(ids) // self.kind.itemsize)

    def close(self) -> None:
        m, none = len(self.keys), sum(k is None for k in self.keys)
        keys = np.array([0 if k is None else k for k in self.keys], np.int64)
        offsets = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.uint64)
        known, first, count = np.unique(keys[none:], return_index=True, return_counts=True)
        index = PerfectHash.build(known)
        slots = np.zeros((len(known), 3), np.uint32)
        slots[index.slots(known)] = np.stack([fingerprint(known), (first + none).astype(np.uint32), count.astype(np.uint32)], axis=1)
        cells = [np.stack([bits, ranks.astype(np.uint64)], axis=1) for bits, ranks in zip(index.levels, index.ranks)]
        foot = np.zeros(LEVELS + 7, np.uint64)
        foot[0], foot[1 : 1 + len(cells)] = len(cells), [len(x) for x in cells]
        foot[-6:] = [m, none, len(known), self.kind.itemsize, int(offsets[-1]) * self.kind.itemsize, MAGIC]
        for x in (keys, offsets, slots, *cells, foot):
            self.out.write(np.ascontiguousarray(x).tobytes())
        self.out.close()
        self.fs.move(self.temp, self.path)


class ShardReader:
    """One shard, read by offset: opening it reads the footer alone."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file, self.cells_read = fs.open_input_file(path), 0
        size, width = self.file.size(), 8 * (LEVELS + 7)
        foot = np.frombuffer(self.file.read_at(width, size - width), np.uint64).astype(np.int64)
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.m, self.none, self.d, self.width, self.keys_at = (int(x) for x in foot[-6:-1])
        self.offsets_at = self.keys_at + 8 * self.m
        self.slots_at = self.offsets_at + 8 * (self.m + 1)
        self.words = foot[1 : 1 + foot[0]].tolist()
        self.levels_at = [self.slots_at + 12 * self.d + 16 * sum(self.words[:i]) for i in range(len(self.words))]

    def cell(self, kind, at: int, n: int) -> np.ndarray:
        self.cells_read += 1
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def slot(self, key: int) -> int:
        """Slot of a key, -1 where no level has a bit for it: one cell a level, fewer than two on average."""
        k = np.array([key], np.int64)
        for level, (words, start) in enumerate(zip(self.words, self.levels_at)):
            at = int(_hash(k, level)[0] % np.uint64(words * 64))
            bits, rank = (int(x) for x in self.cell(np.uint64, start + 16 * (at >> 6), 2))
            if bits >> (at & 63) & 1:
                return rank + (bits & ((1 << (at & 63)) - 1)).bit_count()
        return -1

    def rows_of(self, key: int) -> range:
        """Rows that a key names; empty if the shard does not hold it."""
        slot = self.slot(key)
        if slot < 0:
            return range(0)
        mark, first, count = (int(x) for x in self.cell(np.uint32, self.slots_at + 12 * slot, 3))
        return range(first, first + count) if mark == int(fingerprint(np.array([key], np.int64))[0]) else range(0)

    def ids(self, row: int) -> np.ndarray:
        a, b = (int(x) for x in self.cell(np.uint64, self.offsets_at + 8 * row, 2))
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        return [self.ids(r) for r in self.rows_of(key)]

    def listing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, PerfectHash]:
        """All keys, row offsets, slots and the hash of the shard, for one who reads all of it."""
        keys, offsets = self.cell(np.int64, self.keys_at, self.m), self.cell(np.uint64, self.offsets_at, self.m + 1).astype(np.int64)
        slots = self.cell(np.uint32, self.slots_at, 3 * self.d).reshape(-1, 3)
        return keys, offsets, slots, PerfectHash([np.ascontiguousarray(self.cell(np.uint64, at, 2 * w).reshape(-1, 2)[:, 0]) for w, at in zip(self.words, self.levels_at)])


_SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> list[dict]:
    """Write ``docs(doc_id, text)`` below ``folder``; the shards in order, one small dict each."""
    folder = qualified(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, out, enc = task.partitionId(), None, encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            for key, text in zip(rows_of(batch, "doc_id").to_pylist(), rows_of(batch, "text")):
                if out is None:
                    out = ShardWriter(folder, f"shard-{shard:06d}.ids", enc.kind, f"{task.taskAttemptId()}-{os.getpid()}")
                out.add(key, enc.encode(text.as_py()) + end)
        if out is not None:
            out.close()
            known = [k for k in out.keys if k is not None]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/shard-{shard:06d}.ids", "n_docs": len(out.keys), "n_ids": sum(out.sizes), "low": known[0] if known else None, "high": known[-1] if known else None}], schema=_SHARD)

    docs, size = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts")
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    rows = null_as_empty(docs, "text")
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    # One row for each shard comes back, none for a document.
    shards = dealt.mapInArrow(lean(run), "shard long, path string, n_docs long, n_ids long, low long, high long").collect()
    start, found = 0, []
    for s in sorted(shards, key=lambda s: s.shard):
        found.append(s.asDict() | {"start": start})
        start += s.n_ids
    return found


def read_token_files(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, found through the index."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                r = ShardReader(shard["path"])
                keys, offsets, slots, index = r.listing()
                # Every row is found through the hash: the slot of its key names the first of the rows that share it.
                known = keys[r.none :]
                first = slots[index.slots(known), 1].astype(np.int64)
                nth = np.arange(len(known)) - np.searchsorted(known, known)
                row = np.concatenate((np.arange(r.none), first + nth))
                crc = [zlib.crc32(r.ids(int(i)).tobytes()) for i in row]
                ids = pa.array(keys, mask=np.arange(r.m) < r.none)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shard["start"] + offsets[row]), pa.array(offsets[row + 1] - offsets[row]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    told = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return told.repartition(max(1, len(shards))).mapInArrow(lean(run), kind)


class TokenFiles:
    """Keyed access to shards: the ranges in order, a shard opened when first asked."""

    def __init__(self, shards: list[dict]):
        self.shards = [s for s in shards if s["low"] is not None]
        self.highs, self.open = [s["high"] for s in self.shards], {}

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key: its shard by bisection, and the next ones only where the key lies on a border."""
        out = []
        for s in self.shards[bisect_left(self.highs, key) :]:
            if s["low"] > key:
                break
            if s["path"] not in self.open:
                self.open[s["path"]] = ShardReader(s["path"])
            out += self.open[s["path"]].get(key)
        return out


def find_tokens(shards: list[dict], key: int) -> list[np.ndarray]:
    return TokenFiles(shards).get(key)


def token_table(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or scratch(spark, "token-files"), path, end_id))
