"""Extraction output to records: splitting, repair of delimiters, validation, the better of two passes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.text import without_thoughts

#: The marks of the extraction format.
FIELD, DONE = "<|#|>", "<|COMPLETE|>"


#: Damaged field marks, in the order in which they are put right; {c} stands for the mark's core.
DAMAGED = (
    r"<\|{c}\|*?{c}\|>",
    r"<\|\\{c}\|>",
    r"<\|+>",
    r"<.?\|{c}\|.?>",
    r"<\|?{c}\|?>",
    r"<[^|]{c}\|>|<\|{c}[^|]>",
    r"<\|{c}\|+(?!>)",
    r"<\|{c}:(?!>)",
    r"<\|+{c}>",
    r"<\|\|(?!>)",
    r"(?<!<)\|{c}\|>",
    r"<\|{c}\|>\|",
    r"\|\|{c}\|\|",
)


def repaired(x: Column, core: str = "#") -> Column:
    """Field marks that a model wrote slightly wrong, put right one kind of damage after another."""
    good = FIELD.replace("#", core)
    for bad in DAMAGED:
        x = F.regexp_replace(x, bad.replace("{c}", re.escape(core)), F.lit(good))
    return x


def records(results: DataFrame) -> DataFrame:
    """(chunk, pos, fields array) of ``results(chunk, result)``: one row a record line."""
    lines = F.split(F.replace("result", F.lit(DONE), F.lit("\n")), "\n")
    r = results.select("chunk", F.posexplode(lines).alias("pos", "line")).where(F.trim("line") != "")
    line = F.regexp_replace(F.trim("line"), r"^\(|\)$", "")
    parts = F.transform(F.split(repaired(line), re.escape(FIELD)), lambda p: F.trim(p))
    return r.select("chunk", F.col("pos").cast("long").alias("pos"), parts.alias("fields"))


def bare(x: Column) -> Column:
    """Without outer quotes."""
    return F.trim(F.regexp_replace(F.trim(x), r"^[\"']+|[\"']+$", ""))


def entities(rec: DataFrame, most: int = 256) -> DataFrame:
    """Valid entity records: four fields, a name, a clean type, a description."""
    f = lambda i: F.get("fields", F.lit(i))
    e = rec.where((F.size("fields") == 4) & f(0).contains("entity"))
    kind = F.replace(F.lower(bare(f(2))), F.lit(" "), F.lit(""))
    e = e.select("chunk", "pos", F.substring(bare(f(1)), 1, most).alias("name"), kind.alias("type"), bare(f(3)).alias("description"))
    return e.where((F.col("name") != "") & (F.col("type") != "") & ~F.col("type").rlike(r"['\"()<>|/\\]") & (F.col("description") != ""))


def relations(rec: DataFrame, most: int = 256) -> DataFrame:
    """Valid relation records: five fields, two different ends; a numeric last field is the weight."""
    f = lambda i: F.get("fields", F.lit(i))
    r = rec.where((F.size("fields") == 5) & f(0).contains("relation"))
    weight = F.when(f(4).rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), F.expr("try_cast(fields[4] AS double)")).otherwise(F.lit(1.0))
    r = r.select("chunk", "pos", F.substring(bare(f(1)), 1, most).alias("src"), F.substring(bare(f(2)), 1, most).alias("tgt"), F.replace(bare(f(3)), F.lit("，"), F.lit(",")).alias("keywords"), bare(f(4)).alias("description"), weight.alias("weight"))
    return r.where((F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt")))


def better(passes: DataFrame, keys: list[str]) -> DataFrame:
    """Of one key's rows over several passes, the one with the longest description; the earlier on ties."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length("description")), "pass", "pos"))
    return passes.withColumn("_n", best).where("_n = 1").drop("_n")


def judge_json(x: Column) -> Column:
    """The JSON object in a judge's answer: fenced or bare, without commas before a closing bracket."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare_object = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(fenced != "", fenced).otherwise(bare_object), r",(\s*[}\]])", "$1")


def questions(x: Column) -> Column:
    """All questions in a list of lines ``- Question N: ...``."""
    return F.transform(F.regexp_extract_all(F.replace(x, F.lit("**"), F.lit("")), F.lit(r"- Question [0-9]+: (.+)"), F.lit(1)), lambda s: F.trim(s))


def keyword_lists(answer: Column) -> Column:
    """(hl, ll) of a model's answer: the two lists of its JSON object, past its thinking, fences and stray commas; empty where there is none."""
    told = F.from_json(judge_json(without_thoughts(answer)), "high_level_keywords array<string>, low_level_keywords array<string>")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(told["high_level_keywords"], none).alias("hl"), F.coalesce(told["low_level_keywords"], none).alias("ll"))


def query_keywords(questions: DataFrame, cache: DataFrame, model: Callable[[Column], Column] | None = None, short: int = 50) -> DataFrame:
    """(id, how, hl, ll) of ``questions(id, question, hl, ll)``: the lists given, else those of a cached answer ``(id, answer)``, else the model's.

    A question shorter than ``short`` for which both lists are empty is its own low-level keyword.
    """
    j = questions.join(cache.select("id", keyword_lists(F.col("answer")).alias("_c")), "id", "left")
    given = (F.size("hl") > 0) | (F.size("ll") > 0)
    asked = keyword_lists(model(F.col("question")) if model else F.lit(None).cast("string"))
    how = F.when(given, "given").when(F.col("_c").isNotNull(), "cache").otherwise("model")
    j = j.withColumn("how", how).withColumn("k", F.when(given, F.struct("hl", "ll")).when(F.col("_c").isNotNull(), F.col("_c")).otherwise(asked))
    alone = (F.size("k.hl") == 0) & (F.size("k.ll") == 0) & (F.length("question") < short)
    return j.select("id", "how", F.col("k.hl").alias("hl"), F.when(alone, F.array("question")).otherwise(F.col("k.ll")).alias("ll"))
