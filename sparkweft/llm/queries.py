"""The registered queries of the training-data operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import ann, ball_kmeans, collocations, decontaminate, exact_dedup, html_text, language_id, license_scan, quality, secret_scan
from sparkweft.llm.bpe import encode_digests
from sparkweft.llm.common import read_table
from sparkweft.llm.ngram_join import jaccard_components
from sparkweft.llm.token_files import token_table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is read there, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read_table(spark, sf_dir, "documents")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).where("contaminated").drop("key", "contaminated")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read_table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.digest(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_html_text": op2_html_text,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_ann": op8_ann,
    "op9_bpe": op9_bpe,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_ball_kmeans": op13_ball_kmeans,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _balls_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT v.row, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.x)])::BIGINT AS d FROM v CROSS JOIN c{i} c),
a{i} AS (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY row)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, list(m ORDER BY i) AS x FROM (
  SELECT c, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT a.c, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{i} a JOIN v ON v.row = a.row) GROUP BY c, i) GROUP BY c),
c{i + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    return f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(64 * y)::BIGINT for y in e] AS x
  FROM e WHERE len(e) = 64 AND len([1 for y in e if y IS NOT NULL AND isfinite(y)]) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1)::INTEGER AS c, x FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k}),{",".join(steps)},
s AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c AS cluster, a.d AS distance, cluster_inertia, (SELECT sum(d) FROM a{rounds})::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.row = a.row JOIN s ON s.c = a.c JOIN c{rounds} f ON f.c = a.c
"""


ORACLE_SQL = {
    "op7_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN []
    WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
""",
    "op11_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
u AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM u)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k >= 2),
cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j+1:k], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS j FROM x)),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, p.f AS l, q.f AS r, (2000000::HUGEINT * a) // (p.f::HUGEINT + q.f) AS score, j
  FROM cuts JOIN c p ON p.lang = cuts.lang AND p.phrase = cuts.p JOIN c q ON q.lang = cuts.lang AND q.phrase = cuts.q),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, a, array_to_string(w[i:i+m-1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM x WHERE k >= 3))),
cover AS (SELECT lang, phrase, max(a) AS cover FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN cover USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS k FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM k WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id NULLS LAST)
""",
    "op13_ball_kmeans": _balls_sql(),
}
