"""Byte-level BPE encoding and decoding with a segment tree over pair ranks (operator 9).

The leaves of a binary tree hold the merge rank of every pair of neighbouring
symbols; its root names the leftmost pair of lowest rank. A merge updates at
most three leaves and the nodes above them that change, each in logarithmic
time, until no pair can merge. Every piece of two symbols or more has its
tree; the trees of pieces of up to ``LANES`` symbols stand side by side in one
array and are worked on in step, those of longer ones each by itself. Pieces of
text repeat, so each worker remembers the ids of the pieces it has met, up to
a bound. The vocabulary file's path is a parameter.

Null and empty texts encode to no ids and decode to the empty text. Strings of
added tokens inside a text become those tokens, as in the tokenizers library.
Repeated rows are encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import IntTable, give_back, lean, null_as_empty, rows_of

#: Characters whose classes, folding and composition are the same in every
#: Unicode version and library; other texts are cut by the library itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-įı-ſ]*")
# Letters and numbers among the PLAIN characters.
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class RankTree:
    """Binary min-tree over the ranks of neighbouring pairs; a key holds rank and position in one integer.

    Node 1 is the root, nodes 2i and 2i + 1 are the children of i, and the
    last half are the leaves.
    """

    NONE = 1 << 62

    def __init__(self, keys: list[int]):
        self.size = n = len(keys)
        self.nodes = nodes = keys + keys
        for i in range(n - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def put(self, changes: tuple[tuple[int, int], ...]) -> None:
        """Set leaves and mend the nodes above them, each up to the first that stays as it was."""
        nodes, n = self.nodes, self.size
        for at, key in changes:
            at += n
            nodes[at] = key
            while at > 1:
                other = nodes[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
                if nodes[at] == key:
                    break
                nodes[at] = key


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply the merges to one piece. ranks: left << 20 | right -> rank << 32; merged: the symbol that each rank gives."""
    n = len(symbols)
    if n < 2:
        return symbols
    none, rank = RankTree.NONE, ranks.get
    tree = RankTree([none if (r := rank(a << 20 | b)) is None else r | i for i, (a, b) in enumerate(pairwise(symbols))])
    nodes, put = tree.nodes, tree.put
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := nodes[1]) != none:
        i = low & 0xFFFFFFFF
        j = after[i]
        symbols[i] = s = merged[low >> 32]
        symbols[j] = -1
        after[i] = k = after[j]
        key = none
        if k < n:
            before[k] = i
            if (r := rank(s << 20 | symbols[k])) is not None:
                key = r | i
        changes = ((i, key),) if j == n - 1 else ((j, none), (i, key))
        if (h := before[i]) >= 0:
            changes += ((h, none if (r := rank(symbols[h] << 20 | s)) is None else r | h),)
        put(changes)
    return [s for s in symbols if s >= 0]


#: Symbols of the longest pieces whose trees are worked on together, and pieces at once.
LANES, STEP = 64, 2048


def merge_many(flat: np.ndarray, size: np.ndarray, ranks: IntTable, merged: np.ndarray) -> list[bytes]:
    """``merge`` of many pieces of at most ``LANES`` symbols, one step of all at a time; packed ids of each. flat: the pieces' symbols one after another; ranks: left << 20 | right -> rank."""
    out = [b""] * len(size)
    start = np.cumsum(size) - size
    width = 1 << np.frexp(np.maximum(size, 2) - 1)[1].astype(np.int64)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        for lo in range(0, len(mine), STEP):
            at = mine[lo : lo + STEP]
            place = start[at][:, None] + np.arange(w)
            ids, n = _merge_lanes(flat[np.minimum(place, len(flat) - 1)], size[at], ranks, merged)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            for i, a, b in zip(at.tolist(), [0, *ends], ends):
                out[i] = raw[a:b]
    return out


def _merge_lanes(symbols: np.ndarray, size: np.ndarray, ranks: IntTable, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, ids of each); the width of ``symbols``, a power of two, is the number of leaves of each piece's tree."""
    (m, w), none = symbols.shape, RankTree.NONE
    bits, place = w.bit_length() - 1, np.arange(w)
    inside = place < size[:, None]
    rank, known = ranks.find((symbols[:, :-1] << 20 | symbols[:, 1:]).ravel())
    tree = np.full((m, 2 * w), none)
    tree[:, w:-1] = np.where(known.reshape(m, w - 1) & inside[:, 1:], (rank.reshape(m, w - 1).astype(np.int64) << bits) + place[:-1], none)
    for level in range(bits - 1, -1, -1):
        tree[:, 1 << level : 2 << level] = np.minimum(tree[:, 2 << level : 4 << level : 2], tree[:, (2 << level) + 1 : 4 << level : 2])
    after, before = np.tile(place + 1, (m, 1)).ravel(), np.tile(place - 1, (m, 1)).ravel()
    symbols, tree = symbols.ravel(), tree.ravel()
    lane = np.arange(m)
    while True:
        root = tree[2 * w * lane + 1]
        more = root != none
        if not more.all():
            lane, root = lane[more], root[more]
        if not len(lane):
            break
        row, top, last = lane * w, lane * (2 * w), size[lane]
        i = root & (w - 1)
        j = after[row + i]
        s = merged[root >> bits]
        k = after[row + j]
        symbols[row + i], symbols[row + j], after[row + i] = s, -1, k
        right = k < last
        before[(row + k)[right]] = i[right]
        h = before[row + i]
        left = h >= 0
        # Where no neighbour stands, the place itself is written once more.
        k, h = np.where(right, k, i), np.where(left, h, i)
        rank, known = ranks.find(np.concatenate((s << 20 | symbols[row + k], symbols[row + h] << 20 | s)))
        rank = rank.astype(np.int64) << bits
        key = np.where(known[: len(i)] & right, rank[: len(i)] + i, none)
        tree[top + w + j] = none
        tree[top + w + i] = key
        tree[top + w + h] = np.where(left, np.where(known[len(i) :], rank[len(i) :] + h, none), key)
        nodes = np.concatenate((i, j, h)) + w
        top = np.tile(top, 3)
        for _ in range(bits):
            nodes >>= 1
            under = top + 2 * nodes
            tree[top + nodes] = np.minimum(tree[under], tree[under + 1])
    kept = (symbols.reshape(m, w) >= 0) & inside
    return symbols.reshape(m, w)[kept], kept.sum(axis=1)


class Memo(dict):
    """Remembers the values of a function of one key: the latest ``limit`` keys at least, twice as many at most."""

    def __init__(self, f, limit: int = 120_000):
        super().__init__()
        self.f, self.limit, self.old = f, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Packed ids of pieces of text: of the last ``limit`` distinct ones at least, of twice as many at most, besides those asked for at once."""

    def __init__(self, encode, limit: int = 120_000):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """From now on ``known`` holds all of these."""
        if len(self.known) >= self.limit:
            self.known, self.old = {}, self.known
        new = []
        for p in pieces.difference(self.known):
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                self.known[p] = ids
        if new:
            self.known.update(zip(new, self.encode(new)))


class BytePairCoder:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: r << 32 for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.table = IntTable(np.fromiter(self.ranks, np.int64, len(self.ranks)), np.arange(len(self.ranks), dtype=np.int32))
        self.gives = np.array(self.merged, np.int64)
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in vocab.items():
            self.bytes[i] = bytes(map(back.__getitem__, s))
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.decimals = list(map(str, range(len(self.bytes))))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.of_text = Pieces(lambda new: self._merged([p.encode() for p in new]))
        self.of_letters = Pieces(lambda new: self._merged([bytes(map(back.__getitem__, p)) for p in new]))

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of raw pieces."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short = np.flatnonzero(size <= LANES)
        flat = self.first[np.frombuffer(b"".join([pieces[i] for i in short.tolist()]), np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        for i, ids in zip(short.tolist(), merge_many(flat, size[short], self.table, self.gives)):
            out[i] = ids
        for i in np.flatnonzero(size > LANES).tolist():
            symbols = self.first[np.frombuffer(pieces[i], np.uint8)].tolist()
            out[i] = np.array(merge(symbols, self.ranks, self.merged), "<u4").tobytes()
        return out

    def segments(self, text: str) -> list[tuple[Pieces | None, list[str] | bytes]]:
        """A text as runs of pieces, each with the memo that knows them, and packed ids of added tokens (no memo)."""
        if self.split is not None and any(s in text for s in self.added):
            parts = [p for p in self.split.split(text) if p]
        else:
            parts = [text]
        out: list[tuple[Pieces | None, list[str] | bytes]] = []
        for part in parts:
            if part in self.added:
                out.append((None, array("I", [self.added[part]]).tobytes()))
            elif PLAIN.fullmatch(part):
                out.append((self.of_text, _PIECE.findall(part)))
            else:
                out.append((self.of_letters, [piece for piece, _ in self.cut(part)]))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; the new pieces of all are merged together."""
        cuts = [self.segments(t) for t in texts]
        for memo in (self.of_text, self.of_letters):
            memo.learn({p for c in cuts for m, pieces in c if m is memo for p in pieces})
        return [b"".join([pieces if m is None else b"".join(map(m.known.__getitem__, pieces)) for m, pieces in c]) for c in cuts]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def batches(self, texts: Iterable[str], limit: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of every text, some ``limit`` characters at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= limit:
                yield from (np.frombuffer(x, "<u4") for x in self.encode_many(held))
                held, size = [], 0
        yield from (np.frombuffer(x, "<u4") for x in self.encode_many(held))


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    made = BytePairCoder(path)
    give_back()  # what reading the file took
    return made


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            ids = list(c.batches(t.as_py() for t in rows_of(batch, "text")))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows_of(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([c.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, digested where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            n, told, back = [], [], []
            for ids in c.batches(x.as_py() for x in rows_of(batch, "text")):
                names = ids.tolist()
                n.append(len(names))
                told.append(hashlib.sha256(",".join(map(c.decimals.__getitem__, names)).encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows_of(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
