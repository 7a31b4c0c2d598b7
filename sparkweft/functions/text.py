"""Scalar text functions as column expressions; Python runs, on Arrow batches, in ``unescaped`` alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: w != "")


def hash_id(prefix: str, x: Column | str) -> Column:
    """Prefix and md5 of the text: the id of documents, chunks, entities and relations."""
    return F.concat(F.lit(prefix), F.md5(_c(x)))


def relation_id(a: Column | str, b: Column | str) -> Column:
    """The id of an unordered pair."""
    return hash_id("rel-", F.concat(F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))))


def summary(x: Column | str, most: int = 250) -> Column:
    """The first characters, with dots if any were cut."""
    t = F.trim(_c(x))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def clean(x: Column | str) -> Column:
    """Without control characters and non-characters, outer white space and the five basic HTML escapes."""
    t = F.regexp_replace(_c(x), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFE\\uFFFF]", "")
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(mark), F.lit(plain))
    return F.trim(t)


#: Full-width forms and their ASCII twins.
WIDE = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)]) + "－（）—　"
NARROW = "".join(chr(c - 0xFEE0) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)]) + "-()- "


def normal_name(x: Column | str) -> Column:
    """An entity name in its normal form: no paragraph tags, ASCII letters, no outer quotes; mere numbers vanish."""
    t = F.regexp_replace(_c(x), r"(?i)</?p\s*>|</?br\s*/?>", "")
    t = F.trim(F.translate(t, WIDE, NARROW))
    t = F.regexp_replace(t, r"([一-鿿])\s+(?=[一-鿿])", "$1")
    t = F.regexp_replace(t, "[\"'“”‘’]", F.lit('"'))
    t = F.regexp_replace(t, r'^"([^"]*)"$', "$1")
    t = F.trim(t)
    short = (F.length(t) < 3) & t.rlike(r"^[0-9]+$") | (F.length(t) < 6) & t.rlike(r"^[0-9.]+$") & t.contains(".")
    return F.when(short, F.lit("")).otherwise(t)


def split_marks(x: Column | str, marks: list[str]) -> Column:
    """Parts between any of the marks, trimmed, empty ones left out."""
    import re

    pattern = "|".join(re.escape(m) for m in marks)
    return F.filter(F.transform(F.split(_c(x), pattern), lambda p: F.trim(p)), lambda p: p != "")


def without_thoughts(x: Column | str) -> Column:
    """A model's answer without its thinking."""
    t = F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(t, r"(?s)^.*?</think>", ""))


def estimated_tokens(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(x)) / 4)).cast("long")


def answer_only(x: Column | str) -> Column:
    """An answer up to its list of references."""
    return F.regexp_replace(F.split(_c(x), "### References", 2)[0], r"^\s+|\s+$", "")


def workspace_suffix(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(x), "[^A-Za-z0-9_]", "_"))


def cache_key(mode: Column | str, kind: Column | str, digest: Column | str) -> Column:
    return F.concat_ws(":", _c(mode), _c(kind), _c(digest))


def cache_key_parts(key: Column | str) -> Column:
    """(mode, kind, hash) of a cache key; null if it has no three parts."""
    p = F.split(_c(key), ":", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("mode"), p[1].alias("kind"), p[2].alias("hash")))


def mode_prefix(question: Column | str) -> Column:
    """(mode, only_context, question) of a question that may begin with /mode or /modecontext."""
    known = "local|global|hybrid|naive|mix|beam|focused|bypass"
    q = _c(question)
    pattern = rf"^/({known})?(context)?(?:\s+|$)"
    there = q.rlike(pattern) & q.rlike(rf"^/(?:{known}|context)")
    mode = F.regexp_extract(q, pattern, 1)
    return F.struct(
        F.when(there & (mode != ""), mode).otherwise(F.lit("hybrid")).alias("mode"),
        (there & (F.regexp_extract(q, pattern, 2) == "context")).alias("only_context"),
        F.when(there, F.ltrim(F.regexp_replace(q, pattern, ""))).otherwise(q).alias("question"),
    )


def unescaped(x: Column | str) -> Column:
    """Without HTML escapes of any name or number: there are too many names for an expression, so Arrow batches."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        from html import unescape

        return t.map(lambda s: None if s is None else unescape(s))

    return run(_c(x))


def escapes_decoded(x: Column | str) -> Column:
    """With escapes of the form u and four hexadecimal digits after a backslash read as their characters, and nothing else changed."""
    t = F.regexp_replace(_c(x), r"\\(?!u[0-9a-fA-F]{4})", r"\\\\")
    for raw, told in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(told))
    return F.get(F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>"), F.lit(0))


def created_text(seconds: Column | str) -> Column:
    """Seconds since the epoch as date and time of the session's zone."""
    return F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd HH:mm:ss")


def track_id(prefix: str) -> Column:
    """A fresh id of a batch: prefix, time, random part. It differs from call to call."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
