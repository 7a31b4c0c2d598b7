"""Label search through an index of grams, so that a typed query reads few files.

Labels are indexed, in lower case, by their distinct runs of one to three
characters, in files by a hash of the run, in order of it, with how many labels
hold each. A query of up to three characters is one run; a longer one is looked
up by the rarest few of its runs of three, whose lists are intersected, and
what is left is compared with the whole query. So the rows are those of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.operators.graph import label_score
from sparkweft.operators.lexical import bucket_of
from sparkweft.sources.store import _fs, _path

#: Runs of a query that are looked up at most; the rest is left to the comparison.
RAREST = 4
_POSTINGS, _COUNTS = "gram string, node string, bucket int", "gram string, n bigint, bucket int"


@dataclass
class Labels:
    path: str
    buckets: int


@dataclass
class Found:
    """The best labels, and the files of the index that were read of all."""

    rows: DataFrame
    read: int
    files: int


def grams(label: Column) -> Column:
    """The distinct runs of one to three characters of a label, in lower case."""
    low = F.lower(label)
    each = lambda k: F.when(F.length(low) >= k, F.transform(F.sequence(F.lit(1), F.length(low) - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(each(1), each(2), each(3))))


def index(nodes: DataFrame, path: str, buckets: int = 32, parts: int = 1) -> Labels:
    """Write the index of ``nodes(node)`` below a path. A bucket lies in ``parts`` files, by a salt of the label, as a run may stand in most labels."""
    posts = nodes.where("node is not null").select("node").distinct().select("node", F.explode(grams(F.col("node"))).alias("gram"))
    posts = posts.withColumn("bucket", bucket_of("gram", buckets))
    salt = F.pmod(F.xxhash64("node"), F.lit(parts))
    posts.repartition(buckets * parts, "bucket", salt).sortWithinPartitions("bucket", "gram", "node").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = nodes.sparkSession
    counts = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return Labels(path, buckets)


def search(spark: SparkSession, ix: Labels, query: str, limit: int = 50) -> Found:
    """(node, score) of the ``limit`` best labels for a typed query, as ``graph.search_labels`` has them."""
    low = query.strip().lower()
    asked = sorted({low} if len(low) <= 3 else {low[i : i + 3] for i in range(len(low) - 2)})
    none = spark.createDataFrame([], "node string, score bigint")
    files = _files(spark, f"{ix.path}/postings")
    total = sum(files.values())
    if not low:
        # Every label begins with nothing: there is nothing to look up.
        every = spark.read.schema(_POSTINGS).parquet(f"{ix.path}/postings").select("node").distinct()
        return Found(_best(every, query.strip(), limit), total, total)
    told = spark.createDataFrame([(g,) for g in asked], "gram string").withColumn("bucket", bucket_of("gram", ix.buckets)).collect()
    of = {r.gram: r.bucket for r in told}
    known = spark.read.schema(_COUNTS).parquet(f"{ix.path}/counts").where(F.col("bucket").isin(sorted(set(of.values()))) & F.col("gram").isin(asked)).collect()
    if len(known) < len(asked):
        return Found(none, 0, total)  # some run stands in no label
    rare = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))[:RAREST]]
    buckets = sorted({of[g] for g in rare})
    hit = spark.read.schema(_POSTINGS).parquet(f"{ix.path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(rare))
    both = hit.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("node")
    return Found(_best(both, query.strip(), limit), sum(files.get(b, 0) for b in buckets), total)


def _best(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    s = nodes.select("node", label_score(F.col("node"), query).alias("score"))
    return s.where("score is not null").orderBy(F.desc("score"), "node").limit(limit)


def _files(spark: SparkSession, path: str) -> dict[int, int]:
    """Files of each bucket's directory; there are no more directories than buckets."""
    fs = _fs(spark, path)
    out = {}
    for s in fs.listStatus(_path(spark, path)) if fs.exists(_path(spark, path)) else []:
        name = s.getPath().getName()
        if name.startswith("bucket="):
            out[int(name.removeprefix("bucket="))] = sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(s.getPath()))
    return out
