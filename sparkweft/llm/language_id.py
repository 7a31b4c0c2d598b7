"""Language identification by cross-parsing entropy (operator 3).

For every language a suffix automaton is built of a bounded sample of its
labelled text: the whole texts of ``rows_each`` training rows of smallest id
hash. A text is parsed greedily against each automaton into the longest
phrases that the sample holds; the language that needs the fewest phrases a
character wins (ties: the first name).

The parse is run in lockstep over pieces of ``PIECE`` characters, which cover
whole texts; a phrase ends with its piece. Case is folded and whatever is no
letter reads as a blank. The automata's transitions are one hash table, in
proportion to the samples whatever the alphabets. Null texts and texts without
a letter are ``und`` with score 0, as is everything if no row has a label. The
score is the distance between the best and the second language over the
second's phrases (over one phrase a character if only one language was
learned). Each row is predicted by its text alone; other columns are ignored
but for the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.common import IntTable, give_back, lean, null_as_empty, rows_of

PIECE = 256


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring; state 0 is its root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def normal(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Parser:
    """All languages' automata in one table of transitions."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = {k: normal(v) for k, v in samples.items()}
        letters = sorted({c for t in texts.values() for c in np.unique(t).tolist() if chr(c).isalpha()})
        # Symbol 0 is any letter that no sample has, 1 the blank, the last pads.
        self.code = np.ones(0x110000 + 1, np.int32)
        self.code[[c for c in range(0x40000) if chr(c).isalpha()]] = 0
        for i, c in enumerate(letters):
            self.code[c] = i + 2
        self.width = len(letters) + 3
        self.pad = self.width - 1
        cells, states, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        self.roots = np.zeros(len(self.languages), np.int32)
        # Where a phrase starts with each symbol: the root's next state, or the root.
        self.starts = np.zeros((len(self.languages), self.width), np.int32)
        for k, name in enumerate(self.languages):
            step = suffix_automaton(self.code[texts[name]].tolist())
            self.roots[k] = base
            self.starts[k] = base
            for c, to in step[0].items():
                self.starts[k, c] = base + to
            size = sum(map(len, step))
            cells.append(np.fromiter(((s + base) * self.width + c for s, go in enumerate(step) for c in go), np.int64, size))
            states.append(np.fromiter((to + base for go in step for to in go.values()), np.int32, size))
            base += len(step)
        self.table = IntTable(np.concatenate(cells), np.concatenate(states))

    def phrases(self, pieces: np.ndarray) -> np.ndarray:
        """Phrases of every piece (columns) in every language (rows); pieces has one symbol a row."""
        n, many = pieces.shape[1], len(self.languages)
        at = np.repeat(self.roots[:, None], n, axis=1).ravel()
        count = np.ones(many * n, np.int32)
        language = np.repeat(np.arange(many), n)
        for row in pieces:
            symbols = np.tile(row, many)
            to, found = self.table.find(at.astype(np.int64) * self.width + symbols)
            lost = np.flatnonzero(~found)
            to[lost] = self.starts[language[lost], symbols[lost]]
            ends = symbols == self.pad
            to[ends] = at[ends]
            found |= ends
            count += ~found
            at = to
        return count.reshape(many, n)

    def rates(self, texts: list[str], many: int = 4096) -> np.ndarray:
        """Phrases a character of every text in every language."""
        out = np.zeros((len(self.languages), len(texts)))
        sizes = np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if held:
                pieces = np.concatenate(held, axis=0)
                found = self.phrases(np.ascontiguousarray(pieces.T))
                for k in range(len(self.languages)):
                    out[k] += np.bincount(owner, found[k], minlength=len(texts))
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            s = self.code[normal(text)]
            sizes[i] = len(s)
            rows = -(-len(s) // PIECE)
            if rows:
                flat = np.full(rows * PIECE, self.pad, np.int32)
                flat[: len(s)] = s
                # Long texts go by parts, so that a batch of pieces stays small.
                for lo in range(0, rows, many):
                    part = flat[lo * PIECE : (lo + many) * PIECE].reshape(-1, PIECE)
                    held.append(part)
                    owner += [i] * len(part)
                    if len(owner) >= many:
                        flush()
        flush()
        return out / np.maximum(sizes, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, phrases a character) of every text."""
        asked = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores, best = ["und"] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        rates = self.rates([texts[i] for i in asked])
        if asked:
            order = np.sort(rates, axis=0)
            second = order[1] if len(order) > 1 else np.ones(len(asked))
            score = np.clip((second - order[0]) / np.maximum(second, 1e-12), 0, 1)
            for j, i in enumerate(asked):
                names[i], scores[i], best[i] = self.languages[int(rates[:, j].argmin())], float(score[j]), float(order[0][j])
        return names, scores, best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, rows_each: int = 12) -> dict[str, str]:
    """Training text of every language: the whole texts of a bounded number of rows reach the driver."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "text"))
    rows = train.select("doc_id", "lang", "text").withColumn("nth", rank).where(F.col("nth") <= rows_each).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.nth)):
        out.setdefault(r.lang, []).append(r.text + "\n")
    return {k: "".join(v) for k, v in out.items()}


def trained(docs: DataFrame, **limits: int):
    """A broadcast parser learned from ``docs(doc_id, text, lang)``."""
    told = docs.sparkSession.sparkContext.broadcast(Parser(samples(docs, **limits)))
    give_back()
    return told


def predict(docs: DataFrame, parser) -> DataFrame:
    """(doc_id, lang_pred, score, phrase_rate) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rates = parser.value.predict(rows_of(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([rows_of(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["doc_id", "lang_pred", "score", "phrase_rate"])

    return null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, phrase_rate double")


def identify(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrase_rate) for every row of ``docs(doc_id, text, lang)``."""
    found = predict(docs, trained(docs, **limits))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")


def keep_identified(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` without the rows in which no language is found."""
    parser = trained(docs, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, _ = parser.value.predict(rows_of(batch, "text").to_pylist())
            yield batch.filter(pa.array([n != "und" for n in names], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
