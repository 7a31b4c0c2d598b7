"""Quality classifier by interpolated modified Kneser-Ney perplexity (operator 4).

For every language a character n-gram model is trained on all trusted text
that may teach (``quality`` 1 and not ``toxic``, half of the rows by id hash),
whole texts and every row. Spark counts: workers sum a batch's n-grams, a
group-by sums those; the lower orders' counts, discounts, back-off weights and
probabilities are group-bys and joins of the orders' tables. The tables are
written to the shared folder as shards by n-gram, one file each; the distinct
n-grams of a run of documents are joined with them shard by shard, order by
order, and the joined values, at their places, make each document's
perplexity. Whole texts count. Only the models' alphabets and the names of
their shards reach the driver. (Words are no units here: most words of a text
that no model knows make it look easy, not hard.)

The threshold of a language is a quantile of the perplexities of the trusted
rows that do not teach, with some room. A language without any takes the
quantile over all; without any at all, every row that has a perplexity is
kept. A document is kept if its perplexity is at most the threshold.

Null and empty texts have a perplexity of infinity and are not
kept. Rows whose language has no model are scored by every model, and the
lowest perplexity counts. With no trusted text at all nothing is known:
perplexities are infinite, and no row is kept. Every row gets a row; other
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import lean, null_as_empty, open_fs, possibly_in, rows_of, scratch, slices, stored

SHARDS, ORDER, BITS = 16, 5, 12
#: Rows of a shard file, about, and distinct n-grams that a worker sums before it hands them on.
SHARD_ROWS, HELD = 200_000, 1 << 20


class Table:
    """Sorted keys and a value of each, in shards of equal numbers of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, shards: int = SHARDS):
        self.keys, self.values = keys, values.astype(np.float32)
        self.cuts = np.linspace(0, len(keys), shards + 1).astype(int)

    def join(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of sorted distinct keys; the value of an absent key is 0."""
        out, found, lo = np.zeros(len(keys)), np.zeros(len(keys), bool), 0
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            if a == b:
                continue
            hi = int(np.searchsorted(keys, self.keys[b - 1], side="right"))
            at = np.searchsorted(self.keys[a:b], keys[lo:hi])
            found[lo:hi] = hit = self.keys[a:b][at] == keys[lo:hi]
            out[lo:hi] = np.where(hit, self.values[a:b][at], 0)
            lo = hi
        return out, found


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    return discounts_of([int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)])


def discounts_of(n: list[int]) -> np.ndarray:
    """The same of the numbers of n-grams that count 1, 2, 3 and 4."""
    n = [max(1, k) for k in n]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class Shards:
    """The tables of one language in the shared folder, in files by n-gram; each is opened when first needed."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count, self.open = folder, count, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def shard(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.open:
            fs, path = open_fs(f"{self.folder}/{n}")
            if fs.get_file_info(path).type.name == "NotFound":  # no n-gram fell into it
                self.open[n] = np.zeros(0, np.int64), np.zeros(0, np.float32)
            elif fs.type_name == "local":
                rows = os.path.getsize(path) // 12
                self.open[n] = np.memmap(path, np.int64, "r", 0, rows), np.memmap(path, np.float32, "r", 8 * rows, rows)
            else:
                # Read whole and not kept: memory stays at one shard.
                raw = fs.open_input_file(path).read()
                rows = len(raw) // 12
                return np.frombuffer(raw, np.int64, rows), np.frombuffer(raw, np.float32, rows, 8 * rows)
        return self.open[n]

    def join(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of distinct keys; the value of an absent key is 0."""
        out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        home = keys % self.count
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(self.count + 1))
        for n in np.flatnonzero(cuts[1:] > cuts[:-1]):
            mine = order[cuts[n] : cuts[n + 1]]
            names, values = self.shard(int(n))
            if len(names):
                at = np.minimum(np.searchsorted(names, keys[mine]), len(names) - 1)
                found[mine] = hit = names[at] == keys[mine]
                out[mine] = np.where(hit, values[at], 0)
        return out, found


class Tagged:
    """One order's table within the shards: its keys carry a tag of the order above their symbols."""

    def __init__(self, shards: Shards, tag: int):
        self.shards, self.tag = shards, np.int64(tag)

    def join(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.shards.join(keys | self.tag)


def tag(order: int, back: bool) -> int:
    """What stands above the symbols in a key: contexts have four symbols at most, n-grams five."""
    return 6 << 60 | order << 48 if back else order << 60


class Model:
    """Character n-gram model of any order up to 5. An n-gram is one integer, twelve bits a symbol; 0 is any unknown character, 1 stands before a text."""

    BITS = BITS

    def __init__(self, names: np.ndarray, order: int, tables: list, backs: list):
        self.names, self.order, self.tables, self.backs = names, order, tables, backs
        self.floor = -float(np.log(len(self.names) + 1))

    @classmethod
    def of(cls, texts: list[str], order: int = ORDER) -> Model:
        """A model of texts in memory."""
        points = [normal(t) for t in texts]
        names, count = np.unique(np.concatenate(points), return_counts=True)
        often = np.argsort(-count, kind="stable")[: (1 << cls.BITS) - 2]
        self = cls(np.sort(names[often][count[often] > 1]), order, [], [])
        codes, _ = self.codes(points)
        grams, counts = np.unique(codes, return_counts=True)
        levels = [(grams, counts)]
        for n in range(order - 1, 0, -1):
            # Below the top, an n-gram counts once for each symbol that stands before it.
            levels.append(np.unique(levels[-1][0] & self.mask(n), return_counts=True))
        lower = np.full(1, 1 / (len(self.names) + 1))
        below = np.zeros(1, np.int64)
        for n, (grams, counts) in enumerate(reversed(levels), 1):
            d = discounts(counts)[np.minimum(counts, 3)]
            context, which = np.unique(grams >> self.BITS, return_inverse=True)
            total = np.bincount(which, counts)
            weight = np.bincount(which, d) / total
            lower = np.maximum(counts - d, 0) / total[which] + weight[which] * lower[np.searchsorted(below, grams & self.mask(n - 1))]
            below = grams
            self.tables.append(Table(grams, np.log(lower)))
            self.backs.append(Table(context, np.log(weight)))
        return self

    def mask(self, n: int) -> int:
        return (1 << self.BITS * n) - 1

    def codes(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram that ends at every character of all texts, and each one's text."""
        sizes = np.array([len(p) for p in points])
        at = np.cumsum(sizes + self.order - 1) - sizes
        s = np.ones(int((sizes + self.order - 1).sum()), np.int64)
        text = np.repeat(np.arange(len(points)), sizes)
        place = np.arange(len(text)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        found = np.minimum(np.searchsorted(self.names, flat), len(self.names) - 1)
        s[place] = np.where(self.names[found] == flat, found + 2, 0) if len(self.names) else 0
        code = np.zeros(len(place), np.int64)
        for k in range(self.order - 1, -1, -1):
            code = code << self.BITS | s[place - k]
        return code, text

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of distinct sorted full n-grams: joined with the shards, order by order, until found."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(self.order, 0, -1):
            names, which = np.unique(codes[left] & self.mask(n), return_inverse=True)
            value, found = self.tables[n - 1].join(names)
            contexts, whose = np.unique(names >> self.BITS, return_inverse=True)
            back, _ = self.backs[n - 1].join(contexts)
            out[left] += np.where(found, value, back[whose])[which]
            left = left[~found[which]]
            if not len(left):
                return out
        out[left] += self.floor
        return out

    def log_probabilities(self, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, text = self.codes(points)
        names, which = np.unique(codes, return_inverse=True)
        return self.values(names)[which], text


def normal(text: str) -> np.ndarray:
    """Code points in lower case; white space of any kind is a blank, digits are one symbol."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    p[(p >= 48) & (p <= 57)] = 48
    p[(p >= 9) & (p <= 13)] = 32
    return p


def train(texts: list[str], order: int = ORDER) -> Model | None:
    texts = [t for t in texts if t]
    return Model.of(texts, order) if texts else None


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the rows that a model may learn from."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()


def learns(doc_id: Column) -> Column:
    """Whether a trusted row may teach; the others measure."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0


def _summed(per_text, name: str):
    """A worker that sums, language by language, what ``per_text`` counts in a slice of texts: (lang, name, n) rows, each name once a few slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        many: dict[str, int] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            names, which = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            return names, np.bincount(which, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        def out(lang: str, names: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(names), 1 << 16):
                part = pa.array(names[at : at + (1 << 16)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[at : at + (1 << 16)])], names=["lang", name, "n"])

        for batch in batches:
            langs, texts = rows_of(batch, "lang").to_pylist(), rows_of(batch, "text")
            for at, part in slices(texts):
                points: dict[str, list[np.ndarray]] = {}
                for lang, t in zip(langs[at:], part.to_pylist()):
                    points.setdefault(lang, []).append(normal(t))
                for lang, mine in points.items():
                    names, n = np.unique(per_text(lang, mine), return_counts=True)
                    held.setdefault(lang, []).append((names, n))
                    many[lang] = many.get(lang, 0) + len(names)
                    if many[lang] > HELD:
                        names, n = merged(lang)
                        held[lang], many[lang] = [(names, n)], len(names)
                        if len(names) > HELD // 2:
                            yield from out(lang, names, n)
                            del held[lang], many[lang]
        for lang in held:
            yield from out(lang, *merged(lang))

    return run


def _write_shards(folder: str, places: dict[str, int]):
    """A worker that writes rows sorted by language, shard and key as files of keys, then values; one row a file comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values = None, [], []

        def close() -> pa.RecordBatch:
            fs, path = open_fs(f"{folder}/{places[now[0]]}")
            fs.create_dir(path, recursive=True)
            temp = f"{path}/.{now[1]}.{TaskContext.get().taskAttemptId()}-{os.getpid()}"
            with fs.open_output_stream(temp) as f:
                f.write(np.concatenate(keys).tobytes())
                f.write(np.concatenate(values).tobytes())
            fs.move(temp, f"{path}/{now[1]}")
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, keys))])], names=["rows"])

        for batch in batches:
            langs, shards = batch.column("lang"), batch.column("shard").to_numpy()
            key, value = batch.column("key").to_numpy(), batch.column("value").to_numpy()
            codes = langs.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(codes) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)]):
                if a == b:
                    continue
                here = (langs[int(a)].as_py(), int(shards[a]))
                if here != now and keys:
                    yield close()
                    keys, values = [], []
                now = here
                keys.append(key[a:b])
                values.append(value[a:b].astype(np.float32))
        if keys:
            yield close()

    return run


def taught(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, text) of every row that teaches, whole."""
    ids = stored(trusted(labels).where(learns(F.col("doc_id"))), "teachers")
    rows = docs.where("lang is not null and length(text) > 0").select("doc_id", "lang", "text")
    # Only rows that may teach are moved by the join.
    return stored(possibly_in(rows, "doc_id", ids).join(ids, "doc_id").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), "taught")


def models(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> dict[str, Model]:
    """The models by language; their tables are files in the shared folder."""
    spark = docs.sparkSession
    rows = taught(docs, labels)
    # The alphabets: bounded by the code, some 4,000 symbols a language.
    points = rows.mapInArrow(lean(_summed(lambda _, p: np.concatenate(p), "point")), "lang string, point long, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    points = points.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "point"))).where(F.col("nth") <= (1 << BITS) - 2)
    found: dict[str, list[int]] = {}
    for r in points.groupBy("lang").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("point")))).alias("points")).collect():
        found[r.lang] = r.points
    if not found:
        return {}
    coders = spark.sparkContext.broadcast({k: Model(np.array(v, np.uint32), ORDER, [], []) for k, v in sorted(found.items())})

    level = rows.mapInArrow(lean(_summed(lambda lang, p: coders.value[lang].codes(p)[0], "gram")), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: stored(level, "counts")}
    for n in range(ORDER - 1, 0, -1):
        # Below the top, an n-gram counts once for each symbol that stands before it.
        lower = levels[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[n] = stored(lower, "counts")
    told = [f.select(F.lit(n).alias("order"), "lang", "n").where("n <= 4").groupBy("order", "lang", "n").agg(F.count(F.lit(1)).alias("many")) for n, f in levels.items()]
    many = {(r.order, r.lang, r.n): r.many for f in told for r in f.collect()}

    base = spark.createDataFrame([(k, 0, 1 / (len(v) + 1)) for k, v in found.items()], "lang string, low long, lower double")
    parts = []
    for n in range(1, ORDER + 1):
        off = spark.createDataFrame([(k, *(float(x) for x in discounts_of([many.get((n, k, i), 0) for i in (1, 2, 3, 4)])[1:])) for k in found], "lang string, d1 double, d2 double, d3 double")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows_n = levels[n].join(F.broadcast(off), "lang").select("lang", "gram", "n", d.alias("d"), F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)).alias("low"))
        contexts = rows_n.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        contexts = stored(contexts.select("lang", "context", "total", (F.col("off") / F.col("total")).alias("weight")), "contexts")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        known = stored(rows_n.join(contexts, ["lang", "context"]).join(base, ["lang", "low"]).select("lang", "gram", p.alias("p")), "probabilities")
        parts.append(known.select("lang", F.col("gram").bitwiseOR(F.lit(tag(n, False))).alias("key"), F.log("p").cast("float").alias("value")))
        parts.append(contexts.select("lang", F.col("context").bitwiseOR(F.lit(tag(n, True))).alias("key"), F.log("weight").cast("float").alias("value")))
        base = known.select("lang", F.col("gram").alias("low"), F.col("p").alias("lower"))

    table = parts[0]
    for f in parts[1:]:
        table = table.unionByName(f)
    # One number of shards for all languages: the largest table's.
    shards = max(1, -(-max(r.rows for r in table.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()) // shard_rows)) | 1
    folder, places = scratch(spark, "ngrams"), {k: i for i, k in enumerate(sorted(found))}
    dealt = table.withColumn("shard", F.col("key") % F.lit(shards)).repartition(shards * len(places), "lang", "shard").sortWithinPartitions("lang", "shard", "key")
    dealt.mapInArrow(lean(_write_shards(folder, places)), "rows long").agg(F.sum("rows")).collect()
    out = {}
    for k, v in sorted(found.items()):
        files = Shards(f"{folder}/{places[k]}", shards)
        out[k] = Model(np.array(v, np.uint32), ORDER, [Tagged(files, tag(n, False)) for n in range(1, ORDER + 1)], [Tagged(files, tag(n, True)) for n in range(1, ORDER + 1)])
    return out


def score(docs: DataFrame, learned) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) for every row of ``docs(doc_id, text, lang)``; learned: a broadcast of models by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = learned.value
        for batch in batches:
            langs, texts = rows_of(batch, "lang").to_pylist(), rows_of(batch, "text")
            n, best = np.zeros(len(langs), np.int64), np.full(len(langs), np.inf)
            for at, part in slices(texts, 1 << 19):
                points = [normal(t) for t in part.to_pylist()]
                size = np.array([len(p) for p in points])
                n[at : at + len(part)] = size
                for name, model in by.items():
                    mine = [i for i, p in enumerate(points) if len(p) and (langs[at + i] == name or langs[at + i] not in by)]
                    if mine:
                        logs, text = model.log_probabilities([points[i] for i in mine])
                        mean = np.bincount(text, logs, minlength=len(mine)) / size[mine]
                        rows = at + np.array(mine)
                        best[rows] = np.minimum(best[rows], np.exp(-mean))
            yield pa.RecordBatch.from_arrays([rows_of(batch, "doc_id"), rows_of(batch, "lang"), pa.array(n), pa.array(best)], names=["doc_id", "lang", "n_chars", "perplexity"])

    rows = null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, lang string, n_chars long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, room: float = 1.1) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, keep) for every row of ``docs``."""
    labels = labels.select("doc_id", "quality", "toxic")
    learned = docs.sparkSession.sparkContext.broadcast(models(docs, labels))
    scored = stored(score(docs, learned), "perplexity")
    known = scored.where("perplexity < double('inf')").join(trusted(labels).where(~learns(F.col("doc_id"))), "doc_id")
    cut = lambda: (F.percentile_approx("perplexity", quantile, 10_000) * room).alias("cut")
    each = known.where("lang is not null").groupBy(F.col("lang").alias("l")).agg(cut())
    every = known.agg(cut()).select(F.col("cut").alias("every"))
    told = scored.join(each, F.col("lang") == F.col("l"), "left").join(F.broadcast(every), how="left")
    threshold = F.coalesce("cut", "every", F.when(F.col("perplexity") < float("inf"), F.col("perplexity")))
    return told.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
