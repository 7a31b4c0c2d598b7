import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkweft.llm.common import scratch
from sparkweft.llm.token_files import PerfectHash, ShardWriter, TokenFiles, WordEncoder, find_tokens, read_token_files, token_table, write_token_files
from tests.llm.test_bpe import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")


def want_rows(rows):
    lib = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder():
    lib, enc = Tokenizer.from_file(PATH), WordEncoder(PATH)
    r = random.Random(3)
    for t in TEXTS + ["".join(r.choice("aeThE  \n'.0é<|ÉßÇñ½日İ'S") for _ in range(r.randrange(200))) for _ in range(300)]:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


ROWS = [(i * 7 - 21, t) for i, t in enumerate(TEXTS)] + [(None, None), (None, "b"), (1, "same"), (1, "same"), (1, "also")]


def frames(spark, kind):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, start long")
    if kind == "joined":
        return df.join(spark.range(5, 6).withColumnRenamed("id", "start"), "start")
    return spark.createDataFrame(df.rdd, df.schema) if kind == "rdd" else df.repartition(3)


@pytest.mark.parametrize("kind", ["memory", "joined", "rdd"])
def test_round_trip(spark, kind):
    df = frames(spark, kind)
    shards = write_token_files(df, scratch(spark, "t"), PATH)
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(map(tuple, read_token_files(spark, shards).collect()), key=key) == want_rows(ROWS)
    assert [len(x) for x in find_tokens(shards, 1)] == [2, 2, 2] and find_tokens(shards, 10**9) == [] and find_tokens(shards, 2) == []
    assert token_table(df.limit(0), PATH).count() == 0


def test_keyed_reads(tmp_path):
    """A keyed read finds what was written and reads a bounded number of cells, whatever the shard's size."""
    shards, start = [], 0
    for n, keys in enumerate((range(0, 4000, 2), range(5001, 5002), range(6000, 26_000, 5))):
        w = ShardWriter(f"file://{tmp_path}", f"s{n}", np.dtype("<u2"), "0")
        for k in keys:
            w.add(k, np.array([k % 60_000, 1], "<u2").tobytes())
        w.close()
        shards.append({"path": f"file://{tmp_path}/s{n}", "low": keys[0], "high": keys[-1], "start": start})
    found = TokenFiles(shards)
    reads = []
    for k in [*range(0, 4010), 5001, *range(5990, 26_010)]:
        held = k < 4000 and k % 2 == 0 or k == 5001 or 6000 <= k < 26_000 and k % 5 == 0
        before = sum(r.cells_read for r in found.open.values())
        assert [x.tolist() for x in found.get(k)] == ([[k % 60_000, 1]] if held else []), k
        reads.append(sum(r.cells_read for r in found.open.values()) - before)
    assert max(reads) <= 20 and sum(reads) / len(reads) < 5


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, token_table(docs, PATH).collect())) == sorted(want_rows(rows))
