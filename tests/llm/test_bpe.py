import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkweft.llm.bpe import LANES, BytePairCoder, RankTree, encode_digests, encode_documents, merge, merge_many
from sparkweft.llm.common import IntTable

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a", "Hello  world\n\n it's 42°", "x" * 3000, "ab " * 500 + "\t\r\n", "naïve ſ İ ß Œuvre", "日本語 テキスト 🙂👍🏽", "a<|endoftext|>b  <|endoftext|>", "é ﬁ ​  \x1c\x85", "٣٤٥ ²½", " 　 x", "'S 's 'll'", "\u0000\x7f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_against_library(library):
    c = BytePairCoder(PATH)
    r = random.Random(3)
    letters = "aeth  \n'.0é<|ßçñ½日­"
    for t in TEXTS + ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(300)]:
        want = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == want, t
        assert c.decode(c.encode(t)) == library.decode(want, skip_special_tokens=False), t


class Watched(list):
    """A list that counts what is written to it."""

    written = 0

    def __setitem__(self, at, value):
        self.written += 1
        super().__setitem__(at, value)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 37, 1000])
def test_tree(n):
    """The root is the minimum; a change writes one node a level at most; inner nodes exist for every size."""
    r = random.Random(n)
    keys = [r.randrange(1000) << 32 | i for i in range(n)]
    t = RankTree(list(keys))
    for _ in range(300):
        i = r.randrange(n)
        keys[i] = r.randrange(1000) << 32 | i
        t.nodes = Watched(t.nodes)
        t.put(((i, keys[i]),))
        assert t.nodes[1] == min(keys) and t.nodes.written <= 1 + (n - 1).bit_length()
    assert all(t.nodes[i] == min(t.nodes[2 * i], t.nodes[2 * i + 1]) for i in range(1, n))


def test_tree_does_the_work(monkeypatch, library):
    """Each merge of a long piece reads the tree's root and mends its inner nodes."""
    put, inner = RankTree.put, []

    def watched(self, changes):
        before = self.nodes[1 : self.size]
        put(self, changes)
        inner.append(sum(a != b for a, b in zip(before, self.nodes[1 : self.size])))

    monkeypatch.setattr(RankTree, "put", watched)
    text = "internationalization" * 10
    ids = BytePairCoder(PATH).encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert len(inner) == len(text) - len(ids) and sum(inner) >= len(inner)


def slow(symbols, ranks):
    """Merges by looking through all pairs each time."""
    s = list(symbols)
    while True:
        found = [(ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << 20 | b in ranks]
        if not found:
            return s
        r, i = min(found)
        s[i : i + 2] = [100 + r]


def test_trees_side_by_side():
    """Trees in one array and single trees give what a search of all pairs gives, for ties and for every width."""
    r = random.Random(7)
    names = [*range(6), *range(100, 130)]
    pairs = r.sample([a << 20 | b for a in range(6) for b in range(6)], 20) + r.sample([a << 20 | b for a in names for b in names if a > 9 or b > 9], 100)
    r.shuffle(pairs)
    ranks = {p: i for i, p in enumerate(pairs)}
    table = IntTable(np.array(pairs, np.int64), np.arange(120, dtype=np.int32))
    gives = np.arange(100, 220)
    pieces = [[r.randrange(6) for _ in range(n)] for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 33, LANES] * 40] + [[1] * LANES, [0, 1] * 20]
    want = [slow(p, ranks) for p in pieces]
    got = merge_many(np.concatenate(pieces), np.array(list(map(len, pieces))), table, gives)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [merge(list(p), {k: v << 32 for k, v in ranks.items()}, gives.tolist()) for p in pieces] == want
    assert sum(len(p) - len(w) for p, w in zip(pieces, want)) > 1000


def test_memo_is_bounded(library):
    c = BytePairCoder(PATH)
    c.of_text.limit = 50
    for lo in range(0, 2000, 20):
        texts = [f" w{i} x{i * 7}" for i in range(lo, lo + 20)]
        for t, ids in zip(texts, c.encode_many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(c.of_text.known) + len(c.of_text.old) < 400


def test_long_text(library):
    text = "z" * 30_000 + " " + "word " * 60_000
    assert BytePairCoder(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, encode_digests(df, PATH).collect()), key=key) == sorted(want, key=key)
    assert sorted(((r.doc_id, r.decoded) for r in encode_documents(df, PATH).collect()), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
    assert encode_digests(df.limit(0), PATH).count() == 0
