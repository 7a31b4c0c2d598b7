"""Graph quality, chunk statistics, evaluation and training-set analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators.ranking import numbered, running


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


def schema_correctness(edges: DataFrame, nodes: DataFrame, types: list[str], shortest: int = 2) -> DataFrame:
    """(violation, n) of all triples: ``ok``, or what is wrong with their ends' types or names."""
    n = nodes.select("name", "kind")
    j = edges.join(n.select(F.col("name").alias("src"), F.col("kind").alias("_s")), "src", "left").join(n.select(F.col("name").alias("tgt"), F.col("kind").alias("_t")), "tgt", "left")
    short = (F.length("src") < shortest) | (F.length("tgt") < shortest)
    bad = lambda c: F.col(c).isNull() | ~F.col(c).isin(types)
    what = F.when(short, "short name").when(bad("_s"), F.concat(F.lit("source type "), F.coalesce("_s", F.lit("none")))).when(bad("_t"), F.concat(F.lit("target type "), F.coalesce("_t", F.lit("none")))).otherwise("ok")
    return j.groupBy(what.alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent): counts first, the total over the few counts."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    return g.join(F.broadcast(total), how="cross").select(key, "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("percent"))


def entropy(df: DataFrame, key: str) -> DataFrame:
    """One row (entropy, normalised) of a key's distribution."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    p = F.col("n") / F.col("_t")
    e = g.join(F.broadcast(total), how="cross").agg((-F.sum(p * F.log2(p))).alias("e"), F.max("_k").alias("k"))
    return e.select(F.round("e", 6).alias("entropy"), F.round(F.when(F.col("k") > 1, F.col("e") / F.log2("k")).otherwise(F.lit(0.0)), 6).alias("normalised"))


def token_distribution(df: DataFrame, tokens: str, quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    """One row of count, least, greatest, mean and quantiles (the value at index floor(n q) in order).

    Values are counted first, so the order is taken over distinct values and no
    task sorts all rows.
    """
    g = df.groupBy(F.col(tokens).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    g = running(g, "c", "v", name="upto")
    n = g.agg(F.sum("c").alias("_n"))
    g = g.join(F.broadcast(n), how="cross")
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("_n") * q), F.col("v"))).alias(f"p{round(100 * q)}") for q in quantiles]
    return g.agg(F.max("_n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("_n"), 6).alias("mean"), *at)


def token_buckets(df: DataFrame, tokens: str, cuts: list[int]) -> DataFrame:
    """(bucket, n): how many values lie between the cuts."""
    t, b = F.col(tokens), F
    for lo, hi in zip([0, *cuts[:-1]], cuts):
        b = b.when(t < hi, f"{lo}-{hi - 1}")
    b = b.otherwise(f"{cuts[-1]}+")
    return df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def first_category(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The name of the first rule whose pattern a text matches."""
    out = F
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def eval_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, valid, success, mean, least, greatest): NaN and null count as failures and nowhere else."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    v = F.when(ok, F.col(value))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("valid"), rate(ok).alias("success"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def mode_summary(df: DataFrame, key: str, mode: str, value: str, modes: list[str]) -> DataFrame:
    """(key, a column a mode, winner, spread, versus): means of modes side by side, against the first."""
    p = df.groupBy(key).pivot(mode, modes).agg(F.avg(value))
    cols = [F.col(m) for m in modes]
    top = F.greatest(*cols)
    winner = F.coalesce(*[F.when(c == top, m) for c, m in zip(cols, modes)])
    return p.select(key, *[F.round(c, 6).alias(m) for c, m in zip(cols, modes)], winner.alias("winner"), F.round(top - F.least(*cols), 6).alias("spread"), F.round(100 * (top - cols[0]) / cols[0], 4).alias("versus"))


def win_rates(judged: DataFrame) -> DataFrame:
    """(criterion, n, a, b, tie) percentages of ``judged(criterion, winner, swapped)``: a swapped pair's winner is turned round."""
    w = F.when(F.col("swapped"), F.when(F.col("winner") == "A", "B").when(F.col("winner") == "B", "A").otherwise(F.col("winner"))).otherwise(F.col("winner"))
    p = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return judged.withColumn("w", w).groupBy("criterion").agg(F.count(F.lit(1)).alias("n"), p(F.col("w") == "A").alias("a"), p(F.col("w") == "B").alias("b"), p(~F.col("w").isin("A", "B")).alias("tie"))


def build_time(events: DataFrame, doc: str, at: str) -> DataFrame:
    """One row of a build's times: documents, wall clock, sums and spread of their durations in seconds, parallelism, throughput."""
    s = F.col(at).cast("timestamp").cast("double")
    d = events.groupBy(doc).agg(F.min(s).alias("a"), F.max(s).alias("b")).withColumn("d", F.col("b") - F.col("a"))
    w = F.max("b") - F.min("a")
    n = F.count(F.lit(1))
    return d.agg(n.alias("docs"), F.round(w, 3).alias("wall"), F.round(F.avg("d"), 3).alias("mean"), F.round(F.percentile("d", 0.5), 3).alias("median"), F.round(F.min("d"), 3).alias("least"), F.round(F.max("d"), 3).alias("greatest"), F.round(F.sum("d") / w, 4).alias("parallelism"), F.round(3600 * n / w, 4).alias("per_hour"))


def in_eval(key: Column, percent: int = 10) -> Column:
    """A split of files by hash: no file stands on both sides."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long") % 100 < percent


def triplets(chunks: DataFrame, per_query: int = 2) -> DataFrame:
    """(query, positive, negative, nth): each chunk of ``chunks(id, path)`` with the next chunks of other files.

    Negatives are the ``per_query`` rows of other files that follow in hash
    order, found by offsets in one ring over the files, not by a join of all
    with all: chunks are numbered inside their file, files lie on a ring, and
    the nth negative is a chunk of the nth file after one's own.
    """
    files = numbered(chunks.select("path").distinct().withColumn("_h", F.md5("path")), "_h", name="f").select("path", (F.col("f") - 1).alias("f"))
    m = files.agg(F.count(F.lit(1)).alias("m"))
    sized = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    ring = files.join(sized, "path")
    c = chunks.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1).join(files, "path")
    ask = c.join(F.broadcast(m), how="cross").where("m > 1").withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_query), F.col("m").cast("int") - 1)))).withColumn("g", (F.col("f") + F.col("nth")) % F.col("m"))
    ask = ask.join(ring.select(F.col("f").alias("g"), "size"), "g").withColumn("j", F.col("i") % F.col("size"))
    return ask.select(F.col("id").alias("query"), "nth", "g", "j").join(c.select(F.col("id").alias("negative"), F.col("f").alias("g"), F.col("i").alias("j")), ["g", "j"]).select("query", F.col("query").alias("positive"), "negative", F.col("nth").cast("long").alias("nth"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, cuts=(1, 5, 10), mrr_at: int = 10) -> DataFrame:
    """(queries, mrr, recall at cuts, ndcg) of ``hits(query, rank, id)`` against ``relevant(query, id)``."""
    good = hits.join(relevant, ["query", "id"], "left_semi")
    n = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    gain = 1 / F.log2(F.col("rank") + 1)
    found = good.groupBy("query").agg(F.min("rank").alias("first"), *[F.sum(F.when(F.col("rank") <= c, 1).otherwise(0)).alias(f"h{c}") for c in cuts], F.sum(F.when(F.col("rank") <= mrr_at, gain)).alias("dcg"))
    j = n.join(found, "query", "left")
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(mrr_at)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(z(F.when(F.col("first") <= mrr_at, 1 / F.col("first")))), 6).alias("mrr"), *[F.round(F.avg(z(F.col(f"h{c}") / F.col("n"))), 6).alias(f"recall_{c}") for c in cuts], F.round(F.avg(z(F.col("dcg") / best)), 6).alias("ndcg"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of b that a has."""
    return F.round(F.when(F.size(F.array_distinct(b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(b))).otherwise(F.lit(0.0)), 6)
