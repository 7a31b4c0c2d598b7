"""Chunking as generating expressions: windows over token arrays, delimiter splits, headed sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(tokens: Column, size: int, overlap: int, sep: str = " ", to_end: bool = True) -> Column:
    """Array of (tokens, content) windows of ``size`` tokens, each ``size - overlap`` after the last.

    With ``to_end`` windows start at every step below the number of tokens;
    otherwise they stop with the first that reaches the end.
    """
    step = size - overlap
    n = F.size(tokens)
    count = F.ceil(n / step) if to_end else F.greatest(F.lit(1), F.ceil((n - overlap) / step))
    starts = F.when(n > 0, F.sequence(F.lit(0), (count.cast("int") - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.least(F.lit(size), n - s).cast("long").alias("tokens"), F.trim(F.array_join(F.slice(tokens, s + 1, F.lit(size)), sep)).alias("content")))


def token_windows(docs: DataFrame, size: int = 1200, overlap: int = 100, terms: str = "terms", sep: str = " ") -> DataFrame:
    """(id, chunk_order_index, tokens, content) of ``docs(id, terms)``."""
    return docs.select("id", F.posexplode(windows(F.col(terms), size, overlap, sep)).alias("i", "w")).select("id", F.col("i").cast("long").alias("chunk_order_index"), "w.tokens", "w.content")


def split_windows(docs: DataFrame, mark: str, size: int, overlap: int, only: bool = False, tokenizer=None, sep: str = " ") -> DataFrame:
    """Pieces of ``docs(id, content)`` between marks; a piece of too many tokens is cut into windows, or is an error with ``only``."""
    import re

    tok = tokenizer or (lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    def cut(p: Column) -> Column:
        n = F.size(p.t)
        one = F.array(F.struct(n.cast("long").alias("tokens"), F.trim(p.piece).alias("content")))
        if only:
            return F.when(n > size, F.raise_error(F.lit(f"a piece has more than {size} tokens")).cast(one_type)).otherwise(one)
        return F.when(n > size, windows(p.t, size, overlap, sep)).otherwise(one)

    one_type = "array<struct<tokens:bigint,content:string>>"
    # A piece's tokens are made once, in a column of their own; what follows reads them.
    told = docs.select("id", F.transform(F.split("content", re.escape(mark)), lambda p: F.struct(p.alias("piece"), tok(p).alias("t"))).alias("pieces"))
    return told.select("id", F.posexplode(F.flatten(F.transform("pieces", cut))).alias("i", "w")).select("id", F.col("i").cast("long").alias("chunk_order_index"), "w.tokens", "w.content")


def rerank_windows(docs: DataFrame, most: int = 480, overlap: int = 32, terms: str = "terms", sep: str = " ") -> DataFrame:
    """(id, part, tokens, content): windows for a reranker; the overlap is below the size, and no window lies inside the last."""
    overlap = max(0, min(overlap, most - 1))
    return docs.select("id", F.posexplode(windows(F.col(terms), most, overlap, sep, to_end=False)).alias("part", "w")).select("id", F.col("part").cast("long").alias("part"), "w.tokens", "w.content")


def sections(docs: DataFrame, words: dict[str, str] | None = None) -> DataFrame:
    """(id, chunk_order_index, title, section, content) of markdown ``docs(id, content)``.

    Line ends are unified, a leading source line is taken off, the first ``#``
    line is the title; the text is split before ``##`` lines, every section is
    led by a context line, and sections with a heading alone are left out
    (their index stays free).
    """
    w = {"topic": "Chủ đề", "section": "Mục", "source": "Nguồn"} | (words or {})
    t = F.regexp_replace("content", r"\r\n?", "\n")
    source = F.regexp_extract(t, r"(?m)^# SOURCE_URL:[ \t]*(\S*)", 1)
    body = F.regexp_replace(t, r"(?m)^# SOURCE_URL:.*\n?", "")
    title = F.trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1))
    rest = F.regexp_replace(body, r"(?m)^# .*\n?", "")
    d = docs.select("id", source.alias("source"), title.alias("title"), F.posexplode(F.split(F.concat(F.lit("\n"), rest), r"\n(?=## )")).alias("i", "part"))
    head = F.trim(F.regexp_extract("part", r"(?s)^## ([^\n]*)", 1))
    text = F.trim(F.regexp_replace("part", r"(?s)^## [^\n]*", ""))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    d = d.select("id", F.col("i").cast("long").alias("chunk_order_index"), "title", head.alias("section"), "source", text.alias("text")).where("text <> ''")
    said = lambda k, c: F.when(F.col(c) != "", F.concat(F.lit(w[k] + ": "), c))
    lead = F.concat(F.lit("["), F.concat_ws(" | ", said("topic", "title"), said("section", "section"), said("source", "source")), F.lit("]\n"))
    return d.select("id", "chunk_order_index", "title", "section", F.concat(lead, "text").alias("content"))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks keyed by the md5 of their content: the last of equal chunks in a document stays."""
    c = chunks.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content")))
    return c.withColumn("_n", F.row_number().over(Window.partitionBy("id", "chunk_id").orderBy(F.desc("chunk_order_index")))).where("_n = 1").drop("_n")


def long_enough(chunks: DataFrame, least: int, key: str = "id") -> DataFrame:
    """Chunks of at least so many characters, with an index that counts only those."""
    return chunks.where(F.length("content") >= least).withColumn("valid_index", (F.row_number().over(Window.partitionBy(key).orderBy("chunk_order_index")) - 1).cast("long"))
