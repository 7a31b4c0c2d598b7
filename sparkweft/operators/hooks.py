"""Places for models: embedding, reranking and language-model functions as Arrow-batched columns.

A hook is a plain Python function on a list; it is loaded where it runs, and
nothing here depends on a model or a network.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def embedding(f: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[Column | str], Column]:
    """A column function that embeds texts in batches."""

    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].tolist()
            got = f(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out)

    return run


def reranker(f: Callable[[str, list[str]], list[float]]) -> Callable[[Column | str, Column | str], Column]:
    """A column function that scores documents for their question."""

    @pandas_udf("double")
    def run(question: pd.Series, document: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=document.index)
        for q, at in question.groupby(question).groups.items():
            out[at] = f(q, document[at].tolist())
        return out

    return run


def completion(f: Callable[[list[str]], list[str]]) -> Callable[[Column | str], Column]:
    @pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(f(prompts.tolist()))

    return run


def cached(prompts: DataFrame, cache: DataFrame, answer: Callable[[Column], Column]) -> DataFrame:
    """(key, return, fresh) of ``prompts(key, prompt)``: known answers from the cache, the model for the rest alone."""
    hit = prompts.join(cache.select("key", "return"), "key").select("key", "return", F.lit(False).alias("fresh"))
    rest = prompts.join(cache.select("key"), "key", "left_anti")
    return hit.unionByName(rest.select("key", answer(F.col("prompt")).alias("return"), F.lit(True).alias("fresh")))


def rerank_documents(docs: DataFrame, question: str, score: Callable[[Column | str, Column | str], Column], most: int = 480, overlap: int = 32, how: str = "max", top_n: int | None = None) -> DataFrame:
    """(doc, score, pos) of ``docs(id, terms)``: windows of ``most`` tokens are scored, a document by its windows (max, mean or first), and only then the best ``top_n`` taken.

    So a long document cannot crowd out others by its many windows. Documents
    without tokens, or whose windows all have no score, have no place.
    """
    from sparkweft.operators.chunking import rerank_windows
    from sparkweft.operators.lexical import rerank_aggregate

    parts = rerank_windows(docs, most, overlap).withColumn("question", F.lit(question))
    told = rerank_aggregate(parts.select(F.col("id").alias("doc"), F.col("part").alias("pos"), score("question", "content").alias("score")), how)
    return told if top_n is None else told.where(F.col("pos") <= top_n)
