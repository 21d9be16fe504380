"""Queries of the problems in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, heavy_light, markup, mixture, names, page_difference, stuffing, suffix_counts, term_weight
from lexmill.plans.tables import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- problem 1 ---------------------------------------------------------------

ONCE = """once AS (SELECT DISTINCT * FROM unigrams WHERE token IS NOT NULL AND "nc:id" IS NOT NULL AND count >= 1)"""


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_counts.term_frequencies(table(spark, sf_dir, "unigrams")).filter("mark is not null").select("token", "mark")


@query
def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_counts.term_frequencies(table(spark, sf_dir, "unigrams"))


@query
def p1_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = suffix_counts.ngram_counts(table(spark, sf_dir, "tokenization"), "nc:id", "tokenization", 2)
    return counts.select(F.col("gram")[0].alias("word0"), F.col("gram")[1].alias("word1"), "count", "records")


@query
def p1_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of one to three tokens from one suffix array."""
    counts = suffix_counts.all_ngram_counts(table(spark, sf_dir, "tokenization"), "nc:id", "tokenization", 3)
    return counts.select(*[F.get("gram", F.lit(k)).alias(f"word{k}") for k in range(3)], F.col("n").cast("long").alias("n"), "count", "records")


ORACLES["p1_terms"] = f"""
WITH {ONCE}, n AS (SELECT count(DISTINCT "nc:id") AS n FROM once)
SELECT token, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT "nc:id") AS records,
       CASE WHEN count(DISTINCT "nc:id") < 3 THEN 'rare' WHEN count(DISTINCT "nc:id") > any_value(n.n) * 0.2 THEN 'common' END AS mark
FROM once, n GROUP BY token
"""
ORACLES["p1_found"] = f"SELECT token, mark FROM ({ORACLES['p1_terms']}) WHERE mark IS NOT NULL"
ORACLES["p1_bigrams"] = """
WITH d AS (SELECT DISTINCT * FROM tokenization WHERE tokenization IS NOT NULL AND "nc:id" IS NOT NULL),
e AS (SELECT "nc:id" AS r, unnest(list_zip(tokenization[:-2], tokenization[2:])) AS g FROM d WHERE len(tokenization) >= 2)
SELECT g[1] AS word0, g[2] AS word1, count(*) AS count, count(DISTINCT r) AS records FROM e WHERE g[1] IS NOT NULL AND g[2] IS NOT NULL GROUP BY ALL
"""

ORACLES["p1_ngrams"] = """
WITH d AS (SELECT DISTINCT * FROM tokenization WHERE tokenization IS NOT NULL AND "nc:id" IS NOT NULL),
p AS (SELECT "nc:id" AS r, tokenization AS t, unnest(range(1, len(tokenization) + 1)) AS i FROM d),
g AS (SELECT r, t[i] AS word0, NULL AS word1, NULL AS word2, 1 AS n FROM p
      UNION ALL SELECT r, t[i], t[i + 1], NULL, 2 FROM p WHERE i + 1 <= len(t)
      UNION ALL SELECT r, t[i], t[i + 1], t[i + 2], 3 FROM p WHERE i + 2 <= len(t))
SELECT word0, word1, word2, CAST(n AS BIGINT) AS n, count(*) AS count, count(DISTINCT r) AS records FROM g
WHERE word0 IS NOT NULL AND (n < 2 OR word1 IS NOT NULL) AND (n < 3 OR word2 IS NOT NULL) GROUP BY ALL
"""

# -- problem 2 ---------------------------------------------------------------


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "metadata").select(F.col("author").alias("name"))
    for column in ("advisor", "altadvisor"):
        typed = typed.unionByName(table(spark, sf_dir, "dissertations").select(F.col(column).alias("name")))
    return typed


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(names.name_entities(_typed_names(spark, sf_dir)))


@query
def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_classes(names.name_entities(_typed_names(spark, sf_dir)))


# -- problem 3 ---------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_light.top_items(table(spark, sf_dir, "unigrams"), "token", "count", 40).select(F.col("item").alias("token"))


@query
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_light.top_items(table(spark, sf_dir, "unigrams"), "token", "count", 40).select(F.col("item").alias("token"), "total")


ORACLES["p3_counts"] = """
WITH once AS (SELECT DISTINCT * FROM unigrams WHERE token IS NOT NULL AND count >= 1)
SELECT token, CAST(sum(count) AS BIGINT) AS total FROM once GROUP BY token ORDER BY total DESC, token LIMIT 40
"""
ORACLES["p3_found"] = f"SELECT token FROM ({ORACLES['p3_counts']})"

# -- problem 5 ---------------------------------------------------------------

_TEXTS = [("texts", "@id", "text"), ("split_a", "id", "nc:text")]


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for src, key, text in _TEXTS:
        found = markup.find_markup(table(spark, sf_dir, src).select(f"`{key}`", f"`{text}`"), text).filter("has_markup")
        parts.append(found.select(F.lit(src).alias("src"), F.col(f"`{key}`").alias("rec_id")).distinct())
    return parts[0].unionByName(parts[1])


@query
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [markup.clean_texts(table(spark, sf_dir, src), key, text).select(F.lit(src).alias("src"), "*") for src, key, text in _TEXTS]
    return parts[0].unionByName(parts[1])


@query
def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a URL: documents by repository and path, less the lines shared with the nearest."""
    return page_difference.page_difference(table(spark, sf_dir, "documents"), "doc_id", "repo", "path", "text").withColumnRenamed("page_id", "doc_id")


# -- problem 6 ---------------------------------------------------------------


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weight.characteristic_terms(table(spark, sf_dir, "unigrams")).select("nc_id", "token")


@query
def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = term_weight.distinctive_terms(table(spark, sf_dir, "unigrams"))
    return scores.select("nc_id", "token", "count", "record_total", "records", "token_total", F.round("score", 6).alias("score"))


_P6 = f"""{ONCE},
j AS (SELECT "nc:id" AS nc_id, token, CAST(sum(count) AS BIGINT) AS count FROM once GROUP BY ALL),
r AS (SELECT nc_id, CAST(sum(count) AS BIGINT) AS record_total FROM j GROUP BY nc_id),
t AS (SELECT token, CAST(sum(count) AS BIGINT) AS token_total, count(*) AS records FROM j GROUP BY token),
w AS (SELECT count(*) AS all_records, sum(pow(record_total, 0.75)) AS z FROM r)"""
ORACLES["p6_scores"] = f"""
WITH {_P6}
SELECT nc_id, token, count, record_total, records, token_total,
       round(greatest(0.0, ln(count / token_total * z / pow(record_total, 0.75))), 6) AS score
FROM j JOIN r USING (nc_id) JOIN t USING (token), w
"""
ORACLES["p6_found"] = f"""
WITH {_P6}
SELECT nc_id, token FROM j JOIN r USING (nc_id) JOIN t USING (token), w
WHERE count >= 3 AND count * 25 >= record_total AND records >= 2 AND records * 25 <= all_records
"""

# -- problem 8 ---------------------------------------------------------------


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: the text must come back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("text", F.lit("")).alias("before"))
    back = bpe.decode(bpe.encode(docs))
    return back.select("doc_id", (F.col("text") == F.col("before")).alias("same"))


ORACLES["p8_roundtrip"] = "SELECT doc_id, true AS same FROM documents"

# -- problem 9 ---------------------------------------------------------------


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]

# -- problem 10 --------------------------------------------------------------


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents")).select("doc_id")


@query
def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = stuffing.stuffed_pages(table(spark, sf_dir, "documents"))
    return pages.withColumns({c: F.round(c, 6) for c in ("density", "replicated_share", "evidence")})
