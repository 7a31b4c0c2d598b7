"""Benchmark decontamination by template windows (operator 5).

Words of texts and items are made canonical: case is folded, and numbers,
names (capitalised words inside a sentence) and units after a number become
typed placeholders. Every window of ``WINDOW`` template words is hashed; one of
nothing but placeholders says nothing of a question and is hashed by its values
instead, so that a table of numbers meets only the same numbers. A bitmap of
fixed size holds the benchmark's windows, so that only hits leave the pass over
the texts; where a text repeats one window on end, only as many of its first
and last places leave as any item has on end, for the places between can add
nothing to them. Hits join the benchmark's windows by hash. Hits at
consecutive places of the item on one diagonal (text position less item
position) are a run, and its slots must be consistent: one value of the item
stands for one value in the text. A re-parameterised question passes, a chance
likeness does not. Consistent runs on diagonals nearby are one occurrence.

An item stands in a text if an occurrence has at least half of its windows, or
if one of its consistent runs has 13 words, whatever else hits. Items and texts of fewer words than a window
are compared whole. Null and empty texts hold nothing, and such items are in
no text. A row is judged by its id and text: rows that repeat both share one
row of the result, and ``clean`` drops or keeps them alike. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import BITS, LOWER, byte_view, drop_rows, grams, lean, null_as_empty, rows_of, sequence_hash, slices, stored, words

WINDOW, RUN = 8, 13
#: Windows of a benchmark that may be broadcast: some 200 bytes each.
FEW_WINDOWS = 500_000
#: Diagonals at most so far apart belong to one occurrence.
NEAR = 8
NUMBER, NAME, UNIT = 1, 2, 3
#: Words that are units when a number stands before them.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "lb", "lbs", "oz", "ounce", "ounces", "gram", "grams", "ton", "tons", "tonne", "tonnes", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degree", "degrees",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter", "centimeters", "centimetre", "centimetres",
    "kilogram", "kilograms", "mph", "kmh", "watt", "watts", "volt", "volts",
)

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n\r:;\"")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t'(*_-")] = True


def _folded(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters, byte for byte."""
    out = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    lead = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
    out[lead] += 0x20
    return out


def _hash_of(text: str) -> np.uint64:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), _APART, None)[2][0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))
_SLOT = np.array([0, 0x1F0E3DAD99908345, 0x2B7E151628AED2A6, 0x3243F6A8885A308D], np.uint64)


def template(raw: np.ndarray, ends: np.ndarray):
    """(template hashes, value hashes, is a slot, first word of every text)."""
    low = _folded(raw)
    a, b, value, first = words(low, ends, _APART, None)
    kind = np.zeros(len(a), np.int8)
    if len(a):
        begin = raw[a]
        number = (begin >= 48) & (begin <= 57)
        # A name is capitalised and follows, past blanks, something that ends no sentence.
        upper = (begin >= 65) & (begin <= 90)
        accent = begin == 0xC3
        nxt = raw[np.minimum(a + 1, len(raw) - 1)]
        upper |= accent & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        solid = np.maximum.accumulate(np.where(_SPACE[raw], -1, np.arange(len(raw))))
        before = np.where(a > 0, solid[np.maximum(a - 1, 0)], -1)
        text = np.searchsorted(ends, a, side="right") - 1
        starts = (before < ends[text]) | _ENDS[raw[np.maximum(before, 0)]]
        at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
        unit = _UNIT_HASHES[at] == value
        unit[1:] &= number[:-1]
        unit[0] = False
        kind[upper & ~starts] = NAME
        kind[unit] = UNIT
        kind[number] = NUMBER
    return np.where(kind > 0, _SLOT[kind], value), value, kind > 0, first


_HIT = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("slots", pa.list_(pa.int64())), ("windows", pa.int64())])
_HIT_SQL = "key long, id long, hash long, pos long, slots array<long>, windows long"


def window_hashes(t: np.ndarray, value: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Hash of every window: of its template words, or of its values where all are slots."""
    g = grams(t, WINDOW)
    if len(g):
        many = np.concatenate(([0], np.cumsum(slot)))
        bare = many[WINDOW:] - many[:-WINDOW] == WINDOW
        if bare.any():
            g = np.where(bare, ~grams(value, WINDOW), g)
    return g


def ends_of_runs(keep: np.ndarray, g: np.ndarray, whole: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
    """Of whole windows that follow each other with one hash in one text, the first and the last ``most`` alone."""
    same = np.concatenate(([False], (g[1:] == g[:-1]) & (owner[1:] == owner[:-1]) & whole[1:] & whole[:-1]))
    begin = np.flatnonzero(~same)
    size = np.diff(np.append(begin, len(g)))
    nth = np.arange(len(g)) - np.repeat(begin, size)
    return keep & ((nth < most) | (nth >= np.repeat(size, size) - most))


def _windows(bits=None, most: int = 0):
    """Windows of every text (columns key, id, text): all of them, or those in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value if bits is not None else None
        for batch in batches:
            keys, ids = rows_of(batch, "key").to_numpy(zero_copy_only=False), rows_of(batch, "id").to_pylist()
            for at, part in slices(rows_of(batch, "text")):
                raw, ends = byte_view(part)
                with np.errstate(over="ignore"):
                    t, value, slot, first = template(raw, ends)
                    g = window_hashes(t, value, slot)
                size = np.diff(first)
                owner = np.repeat(np.arange(len(part)), size)[: len(g)]
                inside = np.arange(len(g)) + WINDOW <= first[owner + 1]
                if held is not None:
                    place = (g & np.uint64(BITS - 1)).astype(np.int64)
                    inside &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                    if inside.any():
                        inside = ends_of_runs(inside, g, np.arange(len(g)) + WINDOW <= first[owner + 1], owner, most)
                out = [(at + int(owner[w]), int(g[w : w + 1].view(np.int64)[0]), int(w - first[owner[w]]), value[w : w + WINDOW][slot[w : w + WINDOW]].view(np.int64), int(size[owner[w]]) - WINDOW + 1) for w in np.flatnonzero(inside)]
                for i in np.flatnonzero((size > 0) & (size < WINDOW)):
                    lo, hi = first[i], first[i + 1]
                    with np.errstate(over="ignore"):
                        h = sequence_hash(value[lo:hi] if slot[lo:hi].all() else t[lo:hi])
                    place = int(h[0]) & (BITS - 1)
                    if held is None or held[place >> 3] >> (place & 7) & 1:
                        out.append((at + int(i), int(h.view(np.int64)[0]), 0, value[lo:hi][slot[lo:hi]].view(np.int64), 1))
                if out:
                    row, h, pos, slots, many = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[list(row)]), pa.array([ids[r] for r in row], pa.int64()), pa.array(h), pa.array(pos), pa.array(slots, pa.list_(pa.int64())), pa.array(many)], schema=_HIT)

    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of ``hashes(hash)``: at most 8 MB reach the driver."""
    at = hashes.select((F.col("hash").bitwiseAND(F.lit(BITS - 1)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        out[(r.n - 1) * 4096 : (r.n - 1) * 4096 + len(r.b)] = np.frombuffer(r.b, np.uint8)
    return out


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` and a key of the row's id and text."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items found in texts: (key, doc_id, item_id, windows, item_windows, coverage, slots, consistent, contaminated), the best occurrence of each item in each text."""
    spark = docs.sparkSession
    items = benchmark.select(F.lit(0).cast("long").alias("key"), F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bench = stored(items.mapInArrow(lean(_windows()), _HIT_SQL), "benchmark")
    bits = spark.sparkContext.broadcast(_bitmap(bench))
    texts = null_as_empty(with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "text")
    # How often an item has one window: no fewer than follow each other in it.
    counted = bench.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    hits = texts.select("key", F.col("doc_id").alias("id"), "text").mapInArrow(lean(_windows(bits, counted.most or 0)), _HIT_SQL)
    there = bench.select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("windows").alias("item_windows"))
    # Few windows are broadcast, so that no task gets all hits of a hash; beyond, the join moves both sides, and skewed ones are split.
    there = F.broadcast(there) if (counted["all"] or 0) <= FEW_WINDOWS else there
    # Short texts and items have hashes of their own kind, so they meet only each other.
    pairs = hits.join(there, "hash").where(F.size("slots") == F.size("item_slots"))
    pairs = pairs.select("key", "id", "item_id", "item_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), F.arrays_zip("item_slots", "slots").alias("slots"))
    line = ["key", "id", "item_id", "diagonal"]
    hit = pairs.groupBy(*line, "item_pos").agg(F.max("item_windows").alias("item_windows"), F.collect_set("slots").alias("slots"))
    # In a run of consecutive places, the place less its number on the diagonal stays the same.
    island = F.col("item_pos") - F.row_number().over(Window.partitionBy(*line).orderBy("item_pos"))
    runs = hit.withColumn("island", island).groupBy(*line, "island").agg(F.count(F.lit(1)).alias("length"), F.max("item_windows").alias("item_windows"), F.min("item_pos").alias("low"), F.max("item_pos").alias("high"), F.array_distinct(F.flatten(F.flatten(F.collect_list("slots")))).alias("slots"))
    runs = runs.withColumn("consistent", F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s.item_slots))))
    # Consistent runs on diagonals nearby are one occurrence with words put in or left out: their places add up, each once.
    near = Window.partitionBy("key", "id", "item_id").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    places = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("consistent"), F.sequence("low", "high"))).over(near)))
    runs = runs.withColumn("windows", F.when(F.col("consistent"), F.size(places)).otherwise(F.col("length")).cast("long"))
    runs = runs.withColumn("coverage", F.col("windows") / F.col("item_windows"))
    runs = runs.withColumn("contaminated", F.col("consistent") & ((F.col("coverage") >= 0.5) | (F.col("length") >= RUN - WINDOW + 1)))
    best = runs.groupBy("key", "id", "item_id").agg(F.max(F.struct("contaminated", "windows", "consistent", F.col("diagonal").alias("d"), "item_windows", "coverage", F.size("slots").alias("n"))).alias("b"))
    return best.select("key", F.col("id").alias("doc_id"), "item_id", F.col("b.windows"), F.col("b.item_windows"), F.col("b.coverage"), F.col("b.n").cast("long").alias("slots"), F.col("b.consistent"), F.col("b.contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    found = occurrences(docs, benchmark).where("contaminated").select("key").distinct()
    return drop_rows(with_key(docs), "key", found).select(*docs.columns)
