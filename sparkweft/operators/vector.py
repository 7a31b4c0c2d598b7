"""Vector search: exact top-k, inverted-file top-k, keyed access."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, 0 if either has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def scored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Vectors and their similarity to the one row of ``query(q)``, to six places."""
    return vectors.join(F.broadcast(query.limit(1)), how="cross").withColumn("score", F.round(cosine(F.col("v"), F.col("q")), 6)).drop("q")


def top_k(vectors: DataFrame, query: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k most similar, ties to the smaller id; a sort with a limit, so each task keeps k rows."""
    s = scored(vectors, query)
    if threshold is not None:
        s = s.where(F.col("score") >= threshold)
    return s.orderBy(F.desc("score"), "id").limit(k)


def ranked(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Positions from 1 over a small, already limited list."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def by_ids(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(pos, id)`` with their vectors, misses included, duplicates repeated."""
    return wanted.join(vectors, "id", "left")


def check_dimension(vectors: DataFrame, dims: int) -> DataFrame:
    """Fails on use if any vector has another length."""
    return vectors.where(F.assert_true(F.size("v") == dims, F.lit(f"a vector has not {dims} dimensions")).isNull())


def without_entity(relations: DataFrame, name: str) -> DataFrame:
    return relations.where((F.col("src") != name) & (F.col("tgt") != name))


def centroids(vectors: DataFrame) -> DataFrame:
    """(bucket, c, n): the mean of every bucket, at length one."""
    each = vectors.select("bucket", F.posexplode("v").alias("i", "x")).groupBy("bucket", "i").agg(F.avg("x").alias("x"))
    mean = each.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("c"))
    return mean.join(vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")


def assign_buckets(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Vectors with a bucket by k-means over their directions."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("_n", F.sqrt(dot(F.col("v"), F.col("v")))).withColumn("_f", array_to_vector(F.transform("v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="_b").fit(unit)
    return model.transform(unit).withColumn("bucket", F.col("_b").cast("long")).drop("_n", "_f", "_b")


def bucket_count(n: int, low: int = 32, high: int = 256) -> int:
    return max(low, min(high, int(n**0.5)))


@dataclass(frozen=True)
class Ivf:
    """An inverted file: vectors(id, name, v, bucket), centroids(bucket, c, n) and how many vectors there are."""

    vectors: DataFrame
    centroids: DataFrame
    size: int


#: Below so many vectors an inverted file is searched whole.
FEWEST = 1000


def ivf_save(vectors: DataFrame, path: str, about: str = "") -> Ivf:
    """Write ``vectors(id, name, v, bucket)`` below a folder, a directory a bucket, and the buckets' centroids; what is read back."""
    spark = vectors.sparkSession
    vectors.repartitionByRange("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    kept = spark.read.schema(_filed(vectors)).parquet(f"{path}/vectors")
    centroids(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    n = spark.read.parquet(f"{path}/centroids").agg(F.sum("n").alias("n")).first().n or 0
    spark.createDataFrame([(n, about, _filed(vectors))], "n bigint, about string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return ivf_load(spark, path, about)


def _filed(vectors: DataFrame) -> str:
    """Columns of the stored vectors: the bucket is the directory, so it comes last."""
    kinds = dict(vectors.dtypes)
    return ", ".join(f"{c} {k}" for c, k in kinds.items() if c != "bucket") + f", bucket {kinds['bucket']}"


def ivf_load(spark: SparkSession, path: str, about: str | None = None) -> Ivf:
    """A saved inverted file; fails if it was made of another state than ``about``."""
    told = spark.read.schema("n bigint, about string, kind string").parquet(f"{path}/about").first()
    if about is not None and told.about != about:
        raise ValueError(f"the inverted file at {path} is stale")
    return Ivf(spark.read.schema(told.kind).parquet(f"{path}/vectors"), spark.read.schema("bucket bigint, c array<double>, n bigint").parquet(f"{path}/centroids"), told.n)


def ivf_build(vectors: DataFrame, path: str, about: str = "", seed: int = 42) -> Ivf:
    """An inverted file of ``vectors(id, name, v)``: k-means over their directions, as many buckets as their number asks for."""
    return ivf_save(assign_buckets(vectors, bucket_count(vectors.count()), seed), path, about)


def ivf_probed(ivf: Ivf, query: DataFrame, k: int, probes: int = 5, most: int = 20, factor: int = 3) -> list[int]:
    """Buckets nearest to the query: the probes double until factor * k vectors are in reach or ``most`` buckets are."""
    near = ivf.centroids.join(F.broadcast(query.limit(1)), how="cross").select("bucket", "n", F.round(cosine(F.col("c"), F.col("q")), 6).alias("sim"))
    near = near.orderBy(F.desc("sim"), "bucket").limit(most).collect()  # ``most`` small rows
    while probes < most and sum(r.n for r in near[:probes]) < factor * k:
        probes = min(most, 2 * probes)
    return [r.bucket for r in near[:probes]]


def ivf_top_k(ivf: Ivf, query: DataFrame, k: int, probes: int = 5, most: int = 20, factor: int = 3, threshold: float | None = None, fewest: int = 0) -> DataFrame:
    """Top-k among the probed buckets, of which alone the files are read; of all vectors where the file has less than ``fewest``."""
    if ivf.size < fewest:
        return top_k(ivf.vectors, query, k, threshold)
    return top_k(ivf.vectors.where(F.col("bucket").isin(ivf_probed(ivf, query, k, probes, most, factor))), query, k, threshold)


def upsert_vectors(table: DataFrame, new: DataFrame, embed, text: str = "content", key: str = "id") -> DataFrame:
    """Vectors with those of ``new`` replaced or added; ``embed`` makes a vector column of a text column. Columns the table does not have are left out."""
    fresh = new.withColumn("v", embed(F.col(text))).select([c for c in table.columns if c in [*new.columns, "v"]])
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_vectors(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
