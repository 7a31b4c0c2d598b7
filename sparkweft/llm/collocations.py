"""Phrase collocation mining (operator 11).

Texts are folded (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at
blanks into words. All counts are per language; a null one is ``und``.

1. Equal pieces become one with a multiplicity: in each task first, then over
   all. The distinct pieces are written to the shared folder.
2. n-grams are counted with those multiplicities in duckdb, which may spill to
   the shared folder: each task of pieces counts its own, emptied whenever it
   holds ``HELD`` n-grams, and hands them on packed by a hash of the n-gram;
   a task for each hash bucket adds them up and keeps what occurs ``least``
   times. What cannot reach that is left out before it is counted: a bigram
   whose words, or a longer phrase whose bigrams, do not. Those that do are a
   bitmap of fixed size, whose false hits cost work and change nothing.
3. A candidate is cut after each of its words. Its parts lie in other buckets:
   candidates are dealt into groups, each group asks once for each part, the
   requests are shuffled to the parts' counts and the answers back. So a word
   that begins every phrase is asked for once a group.
4. Longer candidates name the phrases inside them, greatest count first; a
   candidate that one of them covers goes. Each language's best stay.

Scores are floors of quotients of whole numbers, made in decimals of 38
digits. Null and blank texts have no words; an empty table, or one without a
frequent phrase, gives an empty result; repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import BITS, LOWER, byte_view, drop, grams, lean, mix, null_as_empty, open_fs, rows_of, scratch, slices, small_batches, spent, stored, words

_FOLD = LOWER.copy()
_FOLD[[9, 32]] = 32
_FOLD[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 10
_SPACE = np.zeros(256, bool)
_SPACE[32] = True

#: n-grams that a task holds before it hands them on, words given to duckdb at once, and n-grams of a bucket.
HELD, AT_ONCE, BUCKET = 700_000, 250_000, 1_000_000
#: Groups of candidates that ask for parts.
GROUPS = 64

_PIECES = "lang string, piece string, words long, m long"
_PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("bit", pa.int64())])
_COUNTED_SQL = "lang string, k int, phrase string, f long, bit long"


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces, the text of each, words of each): words stand apart by one space; pieces without a word are left out."""
    raw, ends = byte_view(texts)
    b = _FOLD[raw]
    solid = (b != 32) & (b != 10)
    edge = np.zeros(len(b) + 1, bool)
    edge[ends] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    a = np.flatnonzero(begins)
    if not len(a):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(ends, a, side="right") - 1
    cuts = np.cumsum(b == 10)[a]
    opens = np.ones(len(a), bool)
    opens[1:] = (text[1:] != text[:-1]) | (cuts[1:] != cuts[:-1])
    # The words, and one space before each that does not open a piece.
    keep = solid
    keep[a[~opens] - 1] = True
    at = np.cumsum(keep) - keep
    first = np.flatnonzero(opens)
    offsets = np.append(at[a[first]], keep.sum()).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(b[keep]))
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), data]), text[first], np.diff(np.append(first, len(a)))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of whole texts, equal ones of a few megabytes put together."""

    def emit(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).group_by(["lang", "piece"]).aggregate([("words", "min"), ("m", "sum")])
        t = pa.table([t["lang"], t["piece"], t["words_min"], t["m_sum"]], names=["lang", "piece", "words", "m"])
        yield from t.to_batches(max_chunksize=50_000)

    held, size = [], 0
    for batch in batches:
        texts, langs = rows_of(batch, "text"), rows_of(batch, "lang")
        for at, part in slices(texts, 4 << 20):
            piece, text, n = pieces_of(part)
            held.append(pa.table([langs.take(pa.array(text + at)), piece, pa.array(n, pa.int64()), pa.array(np.ones(len(n), np.int64))], names=["lang", "piece", "words", "m"]))
            size += piece.nbytes
        if size > 8 << 20:
            yield from emit(held)
            held, size = [], 0
    if held:
        yield from emit(held)


def weighted_pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, words, m) of ``docs(lang, text)``: each distinct piece and how often it occurs."""
    rows = null_as_empty(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"), "text")
    each = rows.mapInArrow(lean(_split), _PIECES)
    return each.groupBy("lang", "piece").agg(F.min("words").alias("words"), F.sum("m").alias("m"))


def _duck(folder: str):
    """A connection of one thread and little memory, which spills below the shared folder where that is a plain one."""
    import duckdb

    conf = {"threads": 1, "memory_limit": "224MB", "preserve_insertion_order": "false"}
    if folder.startswith("file:"):
        fs, at = open_fs(f"{folder}/{uuid.uuid4().hex}")
        fs.create_dir(at, recursive=True)
        conf["temp_directory"] = at
    return duckdb.connect(":memory:", config=conf)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    d = langs.dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(x.as_py().encode()) for x in d.dictionary], np.uint64)
    return each[d.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _bit_of(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(BITS)).astype(np.int64)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bit_of(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _cut_out(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Slices of a buffer as strings."""
    lengths = stop - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[at]))])


def _grams_of(langs: pa.Array, pieces: pa.Array, m: np.ndarray, sizes: tuple[int, ...], parts: int, bits: np.ndarray | None, buckets: int) -> Iterator[pa.Table]:
    """(bucket, k, lang, phrase, m) of the n-grams of pieces whose every ``parts``-gram is known to ``bits``."""
    raw, ends = byte_view(pieces)
    a, z, h, first = words(raw, ends, _SPACE, None)
    piece = np.repeat(np.arange(len(pieces)), np.diff(first))
    lh = _lang_hashes(langs)
    with np.errstate(over="ignore"):
        known = None
        if bits is not None:
            g = grams(h, parts)
            known = _known(bits, g ^ lh[piece[: len(g)]])
        for k in sizes:
            n = len(h) - k + 1
            if n <= 0:
                continue
            ok = piece[:n] == piece[k - 1 :]
            if known is not None:
                for i in range(k - parts + 1):
                    ok &= known[i : i + n]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            of = piece[at]
            bucket = (mix(grams(h, k)[at] ^ lh[of]) >> np.uint64(32)).astype(np.int64) * buckets >> 32
            yield pa.table([pa.array(bucket, pa.int32()), pa.array(np.full(len(at), k, np.int32)), langs.take(pa.array(of)), _cut_out(raw, a[at], z[at + k - 1]), pa.array(m[of])], names=["bucket", "k", "lang", "phrase", "m"])


def _count(folder: str, sizes: tuple[int, ...], parts: int, known, buckets: int):
    """Pieces to packed counts: a row for each bucket and filling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else known.value
        con = _duck(folder)
        con.execute("CREATE TABLE held (bucket INTEGER, k INTEGER, lang VARCHAR, phrase VARCHAR, c BIGINT)").fetchall()

        def flush() -> Iterator[pa.RecordBatch]:
            t = con.sql("SELECT bucket, k, lang, phrase, sum(c)::BIGINT AS c FROM held GROUP BY ALL ORDER BY bucket").to_arrow_table().combine_chunks()
            con.execute("DELETE FROM held").fetchall()
            con.execute("CHECKPOINT").fetchall()
            b = t["bucket"].to_numpy()
            if not len(b):
                return
            cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            t = t.drop(["bucket"])
            for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([b[lo]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=_PACKED)

        def put(some: list[pa.Table]) -> int:
            con.register("fresh", pa.concat_tables(some))
            con.execute("INSERT INTO held SELECT bucket, k, lang, phrase, sum(m)::BIGINT FROM fresh GROUP BY ALL").fetchall()
            con.unregister("fresh")
            return con.execute("SELECT count(*) FROM held").fetchall()[0][0]

        some, size, held = [], 0, 0
        for batch in batches:
            m, langs = rows_of(batch, "m").to_numpy(), rows_of(batch, "lang")
            for at, part in slices(rows_of(batch, "piece"), 2 << 20):
                for t in _grams_of(langs.slice(at, len(part)), part, m[at : at + len(part)], sizes, parts, bits, buckets):
                    some.append(t)
                    size += len(t)
                if size >= AT_ONCE:
                    held = put(some)
                    some, size = [], 0
                if held >= HELD:
                    yield from flush()
                    held = 0
        if some:
            put(some)
        yield from flush()
        con.close()

    return run


def _add_up(folder: str, least: int):
    """Packed counts of a hash bucket to the n-grams that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck(folder)
        con.execute("CREATE TABLE held (k INTEGER, lang VARCHAR, phrase VARCHAR, c BIGINT)").fetchall()
        some, size = [], 0

        def put() -> None:
            con.register("fresh", pa.concat_tables(some))
            con.execute("INSERT INTO held SELECT k, lang, phrase, sum(c)::BIGINT FROM fresh GROUP BY ALL").fetchall()
            con.unregister("fresh")

        for batch in batches:
            for blob in batch.column(batch.schema.get_field_index("blob")):
                with pa.ipc.open_stream(blob.as_buffer()) as stream:
                    some.append(stream.read_all())
                size += len(some[-1])
                if size >= AT_ONCE:
                    put()
                    some.clear()
                    size = 0
        if some:
            put()
        reader = con.sql(f"SELECT lang, k, phrase, sum(c)::BIGINT AS f FROM held GROUP BY ALL HAVING sum(c) >= {int(least)}").to_arrow_reader(50_000)
        for b in reader:
            langs, phrases, k = rows_of(b, "lang").cast(pa.string()), rows_of(b, "phrase").cast(pa.string()), rows_of(b, "k").to_numpy()
            raw, ends = byte_view(phrases)
            _, _, h, first = words(raw, ends, _SPACE, None)
            bit = np.full(len(phrases), -1, np.int64)
            with np.errstate(over="ignore"):
                lh = _lang_hashes(langs)
                for n in (1, 2):  # longer ones prune nothing
                    own = np.flatnonzero(k == n)
                    if len(own):
                        bit[own] = _bit_of(grams(h, n)[first[own]] ^ lh[own])
            yield pa.RecordBatch.from_arrays([langs, pa.array(k, pa.int32()), phrases, rows_of(b, "f"), pa.array(bit)], schema=_COUNTED)
        con.close()

    return run


def _bitmap(spark: SparkSession, counted: DataFrame):
    """The bits of counted n-grams, 8 MB whatever their number, for all tasks."""
    at = F.col("bit") + 1
    each = counted.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    # Bits are moved, not a half-empty bitmap from every task.
    rows = each.repartition("b").groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return spark.sparkContext.broadcast(bits)


def phrase_counts(pieces: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of up to ``longest`` words in ``pieces(lang, piece, words, m)`` that occur ``least`` times, stored."""
    spark = pieces.sparkSession
    total = pieces.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first().w
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET))
    folder = scratch(spark, "duck")

    def counted(sizes: tuple[int, ...], parts: int, known) -> DataFrame:
        packed = pieces.select("lang", "piece", "m").mapInArrow(lean(_count(folder, sizes, parts, known, buckets)), "bucket int, blob binary")
        return stored(packed.repartitionById(buckets, "bucket").mapInArrow(lean(_add_up(folder, least)), _COUNTED_SQL), "counts")

    out, known, parts = [], None, 0
    for sizes in [(1,), (2,), tuple(range(3, longest + 1))]:
        if sizes:
            out.append(counted(sizes, parts, known))
        if known is not None:
            known.unpersist()
        if sizes in ((1,), (2,)):
            known, parts = _bitmap(spark, out[-1]), sizes[0]
    drop(spark, folder)
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made.drop("bit")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of every phrase of two words and more, by its lowest-scoring cut."""
    group = F.pmod(F.xxhash64("lang", "phrase"), F.lit(GROUPS)).alias("group")
    w = F.split("phrase", " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("cut"), F.array_join(F.slice(w, F.lit(1), j), " ").alias("left"), F.array_join(F.slice(w, j + 1, F.col("k")), " ").alias("right")))
    cut = counts.where("k >= 2").select(group, "lang", "phrase", "k", F.col("f").alias("a"), F.inline(cuts))
    asked = cut.select("group", "lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    answers = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda name, to: answers.select("group", "lang", F.col("part").alias(name), F.col("f").alias(to))
    told = cut.join(of("left", "l"), ["group", "lang", "left"]).join(of("right", "r"), ["group", "lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)").alias("score")
    low = told.select("lang", "phrase", "k", "a", score, "cut", "l", "r").groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")


def uncovered(cands: DataFrame, percent: int = 80, longest: int = 4) -> DataFrame:
    """Rows of ``cands(lang, phrase, k, a, ...)`` that no longer candidate covers: one that holds the words in a row and occurs ``percent`` of as often."""
    w = F.split("phrase", " ", -1)
    inside = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))))
    cover = cands.where("k >= 3").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    covered = F.expr(f"CAST(cover AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {int(percent)}")
    return cands.join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | ~covered).drop("cover")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    spark = docs.sparkSession
    small_batches(spark, 50_000, 4 << 20)
    pieces = stored(weighted_pieces(docs), "pieces", compression="zstd")
    n = pieces.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n"))
    counts = phrase_counts(pieces, least, longest)
    cands = stored(uncovered(scored(counts), percent, longest), "candidates")
    n = stored(n, "totals")
    spent(pieces)
    small_batches(spark)
    # Each task keeps its own best of a language before any rows meet.
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = cands.withColumn("rank", best.cast("long")).where(F.col("rank") <= most)
    return top.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
