"""Fuzzy short-notice search (operator 1).

A notice that may hold ``k`` edits is cut into ``k + 1`` pieces; a text within
``k`` edits holds at least one piece unchanged, and no further than ``k``
characters from its place. One automaton finds all pieces of all notices;
around each hit, every run of whole words whose length fits is matched by the
regex library with at most ``k`` errors, which gives its edits. No run within
the budget is missed. Of runs of one notice that overlap, the one of fewest
edits stays, then the one that starts first, then the shortest. Base phrases
count only where they stand without an edit; near misses of them add a label,
never a base place.

Null and empty texts have no words, no places, empty labels and score 0.
Every place counts, also in repeated rows and in texts of any length; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import lean, null_as_empty, rows_of


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    base: bool = False


#: Words are lower case and stand one blank apart, as in the searched text.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    Notice("apache", "you may not use this file except in compliance with the license", 4),
    Notice("gpl", "the terms of the gnu general public license as published by", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc", "licensed under cc by", 2),
    Notice("cc", "creative commons attribution", 2),
    Notice("reserved", "all rights reserved", 2),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


_BLANK = re.compile(" ")


def fold(text: str) -> str:
    """A-Z to a-z, nothing else."""
    return text.encode().lower().decode()


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        # A pattern for each number of errors, so that the first that matches names the edits.
        self.fuzzy = [[regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)}){{e<={k}}}") for k in range(n.edits + 1)] for n in notices]
        self.letters = [Counter(n.text) for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, n in enumerate(notices):
            size, cuts = len(n.text), n.edits + 1
            for i in range(cuts):
                lo, hi = i * size // cuts, (i + 1) * size // cuts
                seeds.setdefault(n.text[lo:hi], []).append((at, lo))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def edits(self, at: int, run: str) -> int | None:
        """Errors of the regex library's match of a whole run with a notice; None beyond the notice's budget."""
        n = self.notices[at]
        if run == n.text:
            return 0
        # Letters that one has and the other lacks each cost an edit.
        if max((self.letters[at] - (own := Counter(run))).total(), (own - self.letters[at]).total()) > n.edits:
            return None
        return next((k for k, p in enumerate(self.fuzzy[at]) if k and p.fullmatch(run)), None)

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of all places, sorted; text is words one blank apart."""
        found: list[tuple[int, int, int, int]] = []
        tried: set[tuple[int, int, int]] = set()
        starts: list[int] = []
        for end, (size, where) in self.seeds.iter(text):
            if not starts:
                starts = [0, *(m.end() for m in _BLANK.finditer(text))]
            for at, lo in where:
                n = self.notices[at]
                a, k = end + 1 - size - lo, n.edits
                for i in range(bisect_left(starts, a - k), len(starts)):
                    s = starts[i]
                    if s > a + k:
                        break
                    # The ends of words whose run is as long as the budget allows.
                    for j in range(bisect_left(starts, s + len(n.text) - k + 1, i), len(starts) + 1):
                        e = starts[j] - 1 if j < len(starts) else len(text)
                        if e - s > len(n.text) + k:
                            break
                        if e - s >= len(n.text) - k and (at, s, e) not in tried:
                            tried.add((at, s, e))
                            if (edits := self.edits(at, text[s:e])) is not None:
                                found.append((at, edits, s, e))
        return self.best(found)

    @staticmethod
    def best(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of overlapping runs (notice, edits, start, end) of a notice, that of fewest edits, then the first, then the shortest."""
        out: list[tuple[int, int, int, int]] = []
        held: dict[int, tuple[list[int], list[int]]] = {}
        for at, edits, s, e in sorted(found):
            a, b = held.setdefault(at, ([], []))
            i = bisect_left(b, s + 1)
            if i == len(a) or a[i] >= e:
                a.insert(i, s)
                b.insert(i, e)
                out.append((s, e, at, edits))
        return sorted(out)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of ``docs``.

    ``spans`` holds label, first word, word after the last, edits and whether it is a base place.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int,base:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(notices)
        for batch in batches:
            out = []
            for key, text in zip(rows_of(batch, "doc_id").to_pylist(), rows_of(batch, "text")):
                words = _WORD.findall(fold(text.as_py()))
                line = " ".join(words)
                spans, at, n = [], 0, 0
                for a, b, i, e in s.spans(line):
                    n += line.count(" ", at, a)
                    at = a
                    spans.append({"label": notices[i].label, "start": n, "end": n + 1 + line.count(" ", a, b), "edits": e, "base": notices[i].base and not e, "score": 1 - e / len(notices[i].text)})
                base = [x for x in spans if x["base"]]
                out.append({"doc_id": key, "n_words": len(words), "n_base": len(base), "first_word": base[0]["start"] if base else None, "last_word": base[-1]["start"] if base else None, "base_labels": ",".join(sorted({x["label"] for x in base})), "labels": ",".join(sorted({x["label"] for x in spans})), "score": float(max((x["score"] for x in spans), default=0.0)), "spans": [{k: v for k, v in x.items() if k != "score"} for x in spans]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    return null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").mapInArrow(lean(run), kind)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
