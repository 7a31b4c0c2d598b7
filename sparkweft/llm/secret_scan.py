"""Secret scan by dictionary-primed compression novelty (operator 6).

Candidates are the base patterns' matches and, near words that speak of
secrets, any long run of key characters but those no measure can judge: runs
without a letter, and letters of one case (but for a first capital), which in a
language that nobody has told us of are as new as a key. Each candidate is
measured: zstandard, primed with a dictionary, compresses the candidate's
surroundings with and without it; the bytes it adds, over the bytes it has, are
its novelty. The dictionary is trained on names, paths and phrases made of the
commonest words of a public vocabulary file, so it holds words and how often
letters stand in them. A name or path takes about 0.6 bytes a character, a
random run 0.9 and more. Where little surrounds it, letters that no word covers
are stored as they are; so a run of both cases is measured a second time behind
a page of nonsense words, where small letters are cheap and keys are not. What
is no base match is reported, as kind ``novel``, from 0.87 on, and from 0.81
behind the page.

Keys that fill lines are reported whole: a novel run that is all of its line
takes in the lines before and after it that are runs of the same length, and a
last, shorter one that ends in ``=`` or stands before an ``-----END`` line.

Base matches always stay. Null and empty texts hold nothing: counts 0, empty
span list. Rows are scanned one by one and whole; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import lean, null_as_empty, rows_of

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Words near which a long run of key characters is a candidate, and how near.
CONTEXT = ("passw", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "private_key", "private key", "access_key", "access key", "authorization")
REACH = 96
LEAST = 16
_KEY = re.compile(r"[A-Za-z0-9+/_=-]")
_RUN = re.compile(_KEY.pattern + f"{{{LEAST},}}")
_LINE = re.compile(rf"{_KEY.pattern}+")
#: Added bytes a character from which a run is novel, and behind the page. Of names and paths made of words some 2 % reach them, of random keys of
#: 20 characters and more (of both cases, or of one case and digits) 98 % and more; the tests count.
NOVEL, NOVEL_PAGE = 0.87, 0.81
#: What stands around a run at an end of its text: a frame of a few bytes alone tells little.
LEAD, TAIL = b"def call(value):\n    return send(", b', "accept": "*/*"}\n    return send(value)\n'
#: Bytes of the dictionary, words of the vocabulary that teach it, their least letters, and bytes of the page.
DICTIONARY, TEACHING, LETTERS, PAGE = 64 << 10, 12_000, 4, 300

#: Fixed value: what code says around names that are no secrets.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_secret private_key public_key authorization bearer credential username "
    "example placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ getAccessToken refreshToken tokenExpiration setPassword validatePassword passwordResetToken "
    "application configuration environment development production database connection string default value function return import export "
    "class public static final void const self this null none true false https://www.example.com/ http://localhost:8080/ index.html "
    "the and for with that this from have not are was which will would there their about other these more some could into than"
)


@lru_cache(maxsize=4)
def trained_dictionary(path: str | None = None) -> bytes:
    """A dictionary for names, paths and phrases of the first words of a vocabulary file; the same for the same file."""
    import zstandard

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (piece.removeprefix("\u0120") for piece in sorted(vocabulary, key=vocabulary.get))
    words = list(dict.fromkeys(w.lower() for w in whole if len(w) >= LETTERS and w.isascii() and w.isalpha()))[:TEACHING]
    pick = random.Random(5)
    lines = []
    for i in range(0, len(words) - 2, 3):
        rare, often = words[i : i + 3], pick.sample(words[:3000], 3)
        lines += [" ".join(often + rare), rare[0] + "".join(w.capitalize() for w in often), "_".join(often), "/".join(rare), "-".join(pick.sample(words, 3))]
    samples = [" ".join(lines[i : i + 10]).encode() for i in range(0, len(lines), 10)]
    return zstandard.train_dictionary(DICTIONARY, [*samples, IDENTIFIERS.encode()], level=12).as_bytes()


def nonsense(size: int = PAGE) -> str:
    """Words that no dictionary holds."""
    pick, out = random.Random(9), ""
    starts = ("b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "th", "ch", "tr")
    while len(out) < size:
        word = "".join(pick.choice(starts) + pick.choice("aeiou") for _ in range(pick.randrange(2, 5)))
        out += pick.choice((f"{word} ", f"{word} ", f"{word}_", word.capitalize(), f"{word}/", f"{word}{pick.randrange(100)} "))
    return out


def assign_spans(text: str, folded: str) -> list[tuple[int, int]]:
    if not any(h in folded for h in _ASSIGN_HINTS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]


def access_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []


class Novelty:
    """Bytes that a run adds to its surroundings, over its length."""

    def __init__(self, dictionary: bytes | None = None, level: int = 12):
        import zstandard

        primed = zstandard.ZstdCompressionDict(trained_dictionary() if dictionary is None else dictionary)
        primed.precompute_compress(level=level)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.page = nonsense().encode()

    def __call__(self, text: str, a: int, b: int, reach: int = REACH, page: bytes = b"") -> float:
        # Other runs are no surroundings: beside the lines of a key, a further one looks like more of the same.
        run, around = text[a:b].encode(), (text[max(0, a - reach) : a], text[b : b + reach])
        before, after = (_RUN.sub("", x).encode() for x in around)
        before = page + before
        if len(before) < len(LEAD):
            before = LEAD + before
        if len(after) < len(TAIL):
            after += TAIL
        return (len(self.press.compress(before + run + after)) - len(self.press.compress(before + after))) / max(1, len(run))

    def new(self, text: str, a: int, b: int, threshold: float = NOVEL) -> bool:
        """Whether a run is as new as a key."""
        return self(text, a, b) >= threshold and (not both_cases(text[a:b]) or self(text, a, b, page=self.page) >= NOVEL_PAGE)


def zones(folded: str) -> list[tuple[int, int]]:
    """Stretches of text within reach of a sensitive word, in order, merged where they meet."""
    near = []
    for word in CONTEXT:
        at = folded.find(word)
        while at >= 0:
            near.append((max(0, at - REACH), at + len(word) + REACH))
            at = folded.find(word, at + len(word))
    return merged(near)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that spans cover; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def both_cases(run: str) -> bool:
    """Whether letters of both cases stand in a run, a first capital aside."""
    letters = [c for c in run if c.isalpha()]
    return any(c.isupper() for c in letters[1:]) and any(c.islower() for c in letters)


def measurable(run: str) -> bool:
    """Whether novelty can tell a run from a word: it holds letters, and digits or both cases."""
    return any(c.isalpha() for c in run) and (any(c.isdigit() for c in run) or both_cases(run))


def key_block(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The lines of a key of which one line is ``text[a:b]``: those around it that are runs as long, and what is left over below."""
    own = b - a
    if (a and text[a - 1] != "\n") or (b < len(text) and text[b] not in "\r\n"):
        return [(a, b)]
    found = [(a, b)]
    for before in (True, False):
        lo, hi = a, b
        while True:
            if before:
                hi = lo - 1
                lo = text.rfind("\n", 0, max(0, hi)) + 1
                if hi < 0:
                    break
            else:
                end = text.find("\n", hi)
                if end < 0:
                    break
                lo = end + 1
                hi = text.find("\n", lo)
                hi = len(text) if hi < 0 else hi
            stop = hi - 1 if hi > lo and text[hi - 1] == "\r" else hi
            if stop == lo or stop - lo > own or not _LINE.fullmatch(text, lo, stop):
                break
            last = stop - lo < own
            if last and (before or not (text[stop - 1] == "=" or text.startswith("-----END", hi + 1))):
                break
            found.append((lo, stop))
            if last:
                break
    return sorted(found)


def candidate_spans(text: str, folded: str) -> list[tuple[int, int]]:
    """Runs of key characters that begin within reach of a sensitive word. Every character is looked at once."""
    found: list[tuple[int, int]] = []
    done = 0
    for lo, hi in zones(folded):
        at = max(lo, done)
        while m := _RUN.search(text, at, min(len(text), hi + LEAST - 1)):
            if m.start() >= hi:
                break
            whole = _RUN.match(text, m.start())
            done = at = whole.end()
            # A run that began before the stretch is out of reach.
            begins = m.start() == 0 or not _KEY.match(text, m.start() - 1)
            if begins and measurable(whole[0]):
                found.append(whole.span())
    return found


def find_spans(text: str, novelty: Novelty, threshold: float = NOVEL) -> tuple[list[tuple[int, int, str]], list[float]]:
    """All spans as (start, end, kind), by start then kind, and their novelty."""
    folded = text.encode().lower().decode()
    spans = [(a, KINDS.index(k), b) for k, found in (("assign", assign_spans(text, folded)), ("access", access_spans(text)), ("hex", [m.span() for m in _HEX.finditer(text)])) for a, b in found]
    known = merged([(a, b) for a, _, b in spans])
    ends = [b for _, b in known]
    novel: set[tuple[int, int, int]] = set()
    for a, b in candidate_spans(text, folded) if any(w in folded for w in CONTEXT) else ():
        # The first known stretch that ends after the run begins.
        i = bisect_right(ends, a)
        if (a, 3, b) not in novel and (i == len(known) or known[i][0] >= b) and novelty.new(text, a, b, threshold):
            novel |= {(x, 3, y) for x, y in key_block(text, a, b) if (j := bisect_right(ends, x)) == len(known) or known[j][0] >= y}
    spans = sorted([*spans, *novel])
    return [(a, b, KINDS[k]) for a, k, b in spans], [novelty(text, a, b) for a, _, b in spans]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])


def scan(docs: DataFrame, threshold: float = NOVEL, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, novelty>>) for every row of ``docs(doc_id, text)``. The dictionary goes with the tasks."""
    words = trained_dictionary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            spans = []
            for t in rows_of(batch, "text"):
                found, new = find_spans(t.as_py(), novelty, threshold)
                spans.append([{"kind": k, "start": a, "end": b, "novelty": x} for (a, b, k), x in zip(found, new)])
            yield pa.RecordBatch.from_arrays([rows_of(batch, "doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return null_as_empty(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,novelty:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; the spans come in order."""
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.filter("spans", lambda s: s.kind != "novel")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, threshold: float = NOVEL, mark: str = "[secret]", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars`` counted anew where that changed the text."""
    words = trained_dictionary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            texts, sizes = rows_of(batch, "text").to_pylist(), rows_of(batch, "n_chars").to_pylist()
            for i, t in enumerate(texts):
                if not t or not (spans := find_spans(t, novelty, threshold)[0]):
                    continue
                out, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        out += [t[at:a], mark]
                    at = max(at, b)
                texts[i] = "".join(out) + t[at:]
                sizes[i] = len(texts[i])
            cols = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols.get(c, batch.column(j)) for j, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return docs.withColumn("n_chars", F.col("n_chars").cast("long")).mapInArrow(lean(run), docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema)


