"""BM25 over stored postings.

An index is built once: postings, the words with their inverse document
frequency, and one row about the corpus. Saved, postings and words lie in
files by a hash of the word, so that a query reads the buckets of its words
alone. ``about`` tells the state of what was indexed; an index of another
state is stale and is not loaded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    """postings(bucket, term, id, tf, len), terms(bucket, term, df, idf), corpus(n, avg_len)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index(docs: DataFrame, terms: str = "terms", buckets: int = 16) -> Index:
    """An index of ``docs(id, terms)``. A negative idf becomes a share of the mean."""
    sized = docs.select("id", F.size(terms).cast("long").alias("len"), F.sort_array(terms).alias("sorted"))
    # A document's words are counted where it lies: in its sorted words, each run is a word.
    new = lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1))
    runs = sized.where("len > 0").select("id", "len", "sorted", F.filter(F.sequence(F.lit(0), (F.col("len") - 1).cast("int")), new).alias("runs"))
    each = lambda i, k: F.struct(F.get("sorted", i).alias("term"), (F.coalesce(F.get("runs", k + 1), F.col("len")) - i).cast("long").alias("tf"))
    postings = runs.select("id", "len", F.inline(F.transform("runs", each)))
    postings = postings.select(bucket_of("term", buckets).alias("bucket"), "term", "id", "tf", "len")
    corpus = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return Index(postings, _weights(postings, corpus), corpus, buckets)


def _weights(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    df = postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(corpus), how="cross")
    raw = df.select("bucket", "term", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), how="cross").select("bucket", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Words of the texts whose postings one task sorts and writes, about.
PART_WORDS = 1 << 20


def parts_of(words: int, buckets: int) -> int:
    """How many parts of ``PART_WORDS`` words each of ``buckets`` makes."""
    return max(1, -(-words // (buckets * PART_WORDS)))


def save(ix: Index, path: str, about: str = "") -> Index:
    """Write an index below a folder, a bucket in as many files as its words ask for; what is read back. The words are weighed from the postings as written.

    Postings are dealt by bucket and a salt of word and document, so that a word
    of most documents is spread over its bucket's parts.
    """
    spark = ix.postings.sparkSession
    ix.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    told = spark.read.parquet(f"{path}/corpus").first()
    parts = parts_of(round(told.n * (told.avg_len or 0)), ix.buckets)
    salt = F.pmod(F.xxhash64("term", "id"), F.lit(parts))
    ix.postings.repartition(ix.buckets * parts, "bucket", salt).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    postings, corpus = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus")
    _weights(postings, corpus).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(ix.buckets, about)], "buckets int, about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return load(spark, path, about)


def load(spark: SparkSession, path: str, about: str | None = None) -> Index:
    """A saved index; fails if it was made of another state than ``about``."""
    told = spark.read.schema("buckets int, about string").parquet(f"{path}/about").first()
    if about is not None and told.about != about:
        raise ValueError(f"the index at {path} is stale")
    # Types of the ids are those of the documents.
    postings = spark.read.parquet(f"{path}/postings")
    terms = spark.read.schema("term string, df bigint, idf double, bucket int").parquet(f"{path}/terms")
    return Index(postings, terms, spark.read.schema("n bigint, avg_len double").parquet(f"{path}/corpus"), told.buckets)


def top_each(ix: Index, query: DataFrame, k: int) -> DataFrame:
    """(kw, id, score) for every keyword of ``query(kw, term)``: scores above 0 over the keyword's greatest, its k best. A word asked twice counts twice."""
    asked = query.groupBy("kw", "term").agg(F.count(F.lit(1)).alias("qf"))
    words = sorted({r.term for r in asked.select("term").distinct().collect()})  # a query's few words
    spark = ix.postings.sparkSession
    held = spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of("term", ix.buckets).alias("b")).distinct()
    there = F.col("bucket").isin([r.b for r in held.collect()]) & F.col("term").isin(words)
    asked = asked.join(F.broadcast(ix.terms.where(there).select("term", "idf")), "term")
    hit = ix.postings.where(there).join(F.broadcast(asked), "term").join(F.broadcast(ix.corpus), how="cross")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    raw = hit.groupBy("kw", "id").agg(F.sum(part).alias("raw")).where("raw > 0")
    greatest = raw.groupBy("kw").agg(F.max("raw").alias("top"))
    scored = raw.join(F.broadcast(greatest), "kw").withColumn("score", F.round(F.col("raw") / F.col("top"), 6))
    best = F.row_number().over(Window.partitionBy("kw").orderBy(F.desc("score"), "id"))
    return scored.withColumn("_n", best).where(F.col("_n") <= k).select("kw", "id", "score")


def top_k(ix: Index, query: DataFrame, k: int) -> DataFrame:
    """(id, score) for the words of ``query(term)``."""
    return top_each(ix, query.select(F.lit(0).alias("kw"), "term"), k).select("id", "score")


def weighted(semantic: DataFrame, lexical: DataFrame, alpha: float, k: int) -> DataFrame:
    """(id, score) of two ranked lists: alpha times the place in ``semantic(id, pos)`` and the rest times the score in ``lexical(id, score)``."""
    n = semantic.agg(F.count(F.lit(1)).alias("n"))
    s = semantic.join(F.broadcast(n), how="cross").select("id", (1 - (F.col("pos") - 1) / F.col("n")).alias("sem"))
    j = s.join(lexical.select("id", F.col("score").alias("lex")), "id", "full_outer")
    both = alpha * F.coalesce("sem", F.lit(0.0)) + (1 - alpha) * F.coalesce("lex", F.lit(0.0))
    return j.select("id", F.round(both, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def exact_mean(value: str) -> Column:
    """The mean to six places, halves away from 0, of the numbers as they are written: the same in whatever order they are added up.

    A sum of doubles depends on its order, which moves means that lie at a half.
    Where a number or their sum has no place in a decimal of 20 digits before
    the point, the mean of the doubles stands in.
    """
    d = F.col(value).try_cast("decimal(38,18)")
    mean = F.round(F.try_sum(d) / F.count(d).cast("decimal(20,0)"), 6).cast("double")
    return F.coalesce(F.when(F.count(d) == F.count(value), mean), F.round(F.avg(value), 6))


def _round_as_sql(x: Column) -> Column:
    """To six places as SQL engines round doubles: a million times the number, halves of that away from 0."""
    y = F.abs(x) * 1e6
    whole = F.floor(y).cast("double")
    up = F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 1e6
    # Beyond 2^52 there are no halves.
    return F.when(y < 2.0**52, up).otherwise(x)


def means_in_order(parts: DataFrame) -> DataFrame:
    """(doc, score) of parts ``(doc, pos, score)``: the doubles added up one by one in order of ``pos``, as one thread does that reads them so.

    A running sum over a window holds one row at a time, however many parts a document has.
    """
    up_to = Window.partitionBy("doc").orderBy("pos", "score")
    sums = parts.select("doc", F.sum("score").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(up_to).alias("n"))
    return sums.groupBy("doc").agg(F.max_by("sum", "n").alias("sum"), F.max("n").alias("n")).select("doc", _round_as_sql(F.col("sum") / F.col("n")).alias("score"))


def rerank_aggregate(parts: DataFrame, how: str = "max", exact: bool = True) -> DataFrame:
    """(doc, score, pos) of scored parts ``(doc, pos, score)``: max, mean or first; an unknown way is max. Means that are not ``exact`` are those of doubles added up in order of ``pos``."""
    from sparkweft.operators.ranking import numbered

    s = parts.where("score is not null")
    if how == "mean" and not exact:
        return numbered(means_in_order(s), F.desc("score"), "doc")
    agg = {"mean": exact_mean("score"), "first": F.round(F.min_by("score", "pos"), 6)}.get(how, F.round(F.max("score"), 6))
    return numbered(s.groupBy("doc").agg(agg.alias("score")), F.desc("score"), "doc")
