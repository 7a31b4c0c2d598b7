import hashlib

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from sparkweft.llm import language_id
from sparkweft.llm.common import shared_dir, stored
from sparkweft.llm.secret_scan import Novelty, find_spans
from tests.llm import brute, test_decontaminate

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_edge_rows(spark, sf_dir):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "en", "s", 3), (2, text, "en", "s", 3), (3, text + " x", "de", "s", 3), (None, text, "en", "s", 3), (4, None, None, None, None), (5, "12 !", "en", "s", 1), (7, "another row of words that nobody has", "fr", "s", 1), (7, "another row of words that nobody has", "fr", "t", 1), (7, "the same id over a different text here", "fr", "t", 1)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], KIND + ", key int")
    one = stored(P.identify_language(spark, docs, sf_dir), "t")
    assert one.columns == P.COLUMNS and sorted(str(r.doc_id) for r in one.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (4, 5))
    two = stored(P.drop_near_duplicates(spark, one, sf_dir), "t")
    assert two.columns == P.COLUMNS and sorted((r.doc_id, r.source) for r in two.collect()) == [(1, "s"), (7, "s"), (7, "t")]
    assert P.drop_near_duplicates(spark, two.limit(0), sf_dir).count() == 0


def test_edge_rows_of_later_stages(spark, sf_dir):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns through stages 3 to 5."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    key = "password=b7db7aa4a5fcc78305"
    long = "many plain words follow here " * 20_000
    rows = [
        (1, "clean text", "en", "s", 10), (1, "clean text", "en", "s", 10), (2, None, None, None, None), (3, "", None, "s", 0), (None, f"x {key} y", "de", None, None), (None, f"x {key} y", "de", None, None),
        (4, "before " + item + " after", "en", "s", 7), (4, "the same id over another text", "en", "s", 7), (5, long + key, None, "s", None), (6, long + item, "en", "s", 1),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", key string, novelty int")
    three = stored(P.remove_benchmark(spark, docs, sf_dir), "t")
    want = [r for r in rows if not (r[1] or "").endswith((item, item + " after"))]
    assert three.columns == P.COLUMNS and sorted(map(tuple, three.collect()), key=str) == sorted(want, key=str) and len(want) == 8
    four = stored(P.redact_secrets(spark, three, sf_dir), "t")
    clean = [(d, t.replace(key, "[secret]"), lang, s, len(t.replace(key, "[secret]"))) if t and key in t else (d, t, lang, s, n) for d, t, lang, s, n in want]
    assert four.columns == P.COLUMNS and sorted(map(tuple, four.collect()), key=str) == sorted(clean, key=str)
    five = P.encode_tokens(spark, four, sf_dir).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r.doc_id, r.n_tokens) for r in five), key=str) == sorted(((d, len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in clean), key=str)


def test_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS).limit(0)
    for _, stage in P.STAGES:
        at = stage(spark, docs, sf_dir)
        assert at.count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS).limit(50)
    assert P.remove_benchmark(spark, full, str(tmp_path)).count() == 50


def test_what_is_stored_on_the_way_goes(spark, sf_dir):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = P.run(spark, sf_dir)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and out.count() > 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    frames = {}
    at = docs
    for name, stage in P.STAGES:
        at = stored(stage(spark, at, sf_dir), "t")
        frames[name] = [tuple(r) for r in at.collect()]
    names, _, _ = language_id.trained(docs).value.predict([r[1] for r in rows])
    want = [r for r, n in zip(rows, names) if n != "und"]
    assert sorted(frames["language_id"]) == sorted(want)
    low = {d: c for d, _, c in brute.jaccard_components([r[:2] for r in want])}
    want = [r for r in want if low[r[0]] == r[0]]
    assert sorted(frames["ngram_jaccard_join"]) == sorted(want) and len(want) < len(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, t, *_ in want for _, q in items if q in t}
    bad = {d for d, _ in test_decontaminate.brute([r[:2] for r in want if r[0] in hit], items)}
    want = [r for r in want if r[0] not in bad]
    assert sorted(frames["decontamination"]) == sorted(want) and bad
    out, novelty = [], Novelty()
    for d, t, lang, source, n in want:
        parts, end = [], 0
        for a, b, _ in find_spans(t, novelty)[0]:
            if a >= end:
                parts += [t[end:a], "[secret]"]
            end = max(end, b)
        new = "".join(parts) + t[end:]
        out.append((d, new, lang, source, len(new) if parts else n))
    assert sorted(frames["secret_scan"]) == sorted(out) and out != want
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(d, lib.encode(t, add_special_tokens=False).ids, t) for d, t, *_ in out]
    assert sorted(frames["bpe"]) == sorted((d, len(x), sha(",".join(map(str, x))), sha(t)) for d, x, t in ids)
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(frames["bpe"])
