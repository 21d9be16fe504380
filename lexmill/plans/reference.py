"""Queries of the corpus engine's own operators, each with the same query in SQL.

All run over whole tables.  ``documents`` is the corpus (nc:id is doc_id) and
``texts`` a second one; the TPC-H-like tables and the catalogs serve the catalog
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import common_prefix, document_words, extract_year, tokenize
from lexmill.operators import catalog, features, vectors
from lexmill.plans.tables import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.texts(table(spark, sf_dir, "documents"), "doc_id", "text")


_T = r"""t AS (SELECT doc_id AS "nc:id", regexp_split_to_array(text, '[^\p{L}]') AS t FROM documents WHERE text IS NOT NULL)"""
_P = f"""{_T}, p AS (SELECT "nc:id", t, unnest(range(1, len(t) + 1)) AS i FROM t)"""


# -- text features ---------------------------------------------------------------


@query
def tokenize_lengths(spark, sf_dir):
    return features.document_lengths(corpus(spark, sf_dir))


ORACLES["tokenize_lengths"] = r"""SELECT doc_id AS "nc:id", CAST(len(regexp_split_to_array(text, '[^\p{L}]')) AS BIGINT) AS nwords FROM documents"""


@query
def tokenization_rows(spark, sf_dir):
    """Every token with its place."""
    t = features.tokenization(corpus(spark, sf_dir))
    return t.select("`nc:id`", F.posexplode("tokenization").alias("pos", "token")).select("`nc:id`", F.col("pos").cast("long").alias("pos"), "token")


ORACLES["tokenization_rows"] = f"""WITH {_P} SELECT "nc:id", i - 1 AS pos, t[i] AS token FROM p"""


@query
def document_word_counts(spark, sf_dir):
    c = corpus(spark, sf_dir).repartition(F.col("`nc:id`"))
    return c.select("`nc:id`", F.explode(document_words("text")).alias("token")).groupBy("`nc:id`", "token").agg(F.count("*").alias("count"))


ORACLES["document_word_counts"] = r"""
WITH w AS (SELECT doc_id AS "nc:id", unnest(regexp_extract_all(text, '[\p{L}\p{N}_^]+|[^\p{L}\p{N}_\s\p{Z}]+')) AS token FROM documents)
SELECT "nc:id", token, count(*) AS count FROM w GROUP BY ALL
"""


def _grams(name: str, n: int) -> None:
    def run(spark, sf_dir):
        return features.ngram_counts(corpus(spark, sf_dir), n, one_row_each=True)  # doc_id is unique

    QUERIES[name] = run
    words = ", ".join(f"t[i + {k}] AS word{k}" for k in range(n))
    ORACLES[name] = f"""WITH {_P} SELECT "nc:id", {words}, count(*) AS count FROM p WHERE i + {n - 1} <= len(t) GROUP BY ALL"""


for _name, _n in features.GRAMS.items():
    _grams(_name, _n)


@query
def bigrams_within_sentences(spark, sf_dir):
    """Bigrams that don't go on past an empty token."""
    return features.ngram_counts(corpus(spark, sf_dir), 2, end_tokens=[""])


ORACLES["bigrams_within_sentences"] = f"""WITH {_P} SELECT "nc:id", t[i] AS word0, t[i + 1] AS word1, count(*) AS count FROM p WHERE i + 1 <= len(t) AND t[i] <> '' GROUP BY ALL"""


@query
def vocabulary(spark, sf_dir):
    return features.vocabulary(corpus(spark, sf_dir))


_VOCAB = f"""{_P}, v AS (SELECT t[i] AS token, count(*) AS count FROM p GROUP BY ALL), vocab AS (
  SELECT token, count, row_number() OVER (ORDER BY count DESC, token) - 1 AS wordid FROM v)"""
ORACLES["vocabulary"] = f"WITH {_VOCAB} SELECT * FROM vocab WHERE wordid < 1000000"


def encoded_sql(n: int, cap: int) -> str:
    words = ", ".join(f"t[i + {k}] AS w{k}" for k in range(n))
    names = ["wordid"] if n == 1 else [f"word{k + 1}" for k in range(n)]
    ids = ", ".join(f"v{k}.wordid AS {x}" for k, x in enumerate(names))
    joins = " ".join(f"LEFT JOIN capped v{k} ON v{k}.token = g.w{k}" for k in range(n))
    return f"""
WITH {_VOCAB}, capped AS (SELECT * FROM vocab WHERE wordid < {cap}), g AS (SELECT "nc:id", {words}, count(*) AS count FROM p WHERE i + {n - 1} <= len(t) GROUP BY ALL)
SELECT g."nc:id", {ids}, g.count FROM g {joins}"""


def _encoded(name: str, n: int) -> None:
    def run(spark, sf_dir):
        c = corpus(spark, sf_dir)
        return features.encode(features.ngram_counts(c, n, one_row_each=True), features.vocabulary(c), n)

    QUERIES[name], ORACLES[name] = run, encoded_sql(n, features.VOCABULARY_CAP)


for _name, _n in (("encoded_unigrams", 1), ("encoded_bigrams", 2), ("encoded_trigrams", 3)):
    _encoded(_name, _n)


@query
def ngrams_nested(spark, sf_dir):
    """The nested form, checked by its size and its words in order."""
    nested = features.nested_ngrams(corpus(spark, sf_dir), 2, "bigrams")
    shown = F.array_join(F.transform("bigrams", lambda g: F.concat_ws(" ", g["word0"], g["word1"], g["count"].cast("string"))), "|")
    return nested.select("`nc:id`", F.size("bigrams").cast("long").alias("grams"), F.md5(shown).alias("content"))


ORACLES["ngrams_nested"] = f"""
WITH {_P}, g AS (SELECT "nc:id", t[i] AS w0, t[i + 1] AS w1, count(*) AS n FROM p WHERE i + 1 <= len(t) GROUP BY ALL),
a AS (SELECT "nc:id", count(*) AS grams, md5(string_agg(w0 || ' ' || w1 || ' ' || n, '|' ORDER BY w0, w1)) AS content FROM g GROUP BY ALL)
SELECT doc_id AS "nc:id", coalesce(grams, 0) AS grams, coalesce(content, md5('')) AS content FROM documents LEFT JOIN a ON a."nc:id" = doc_id
"""


@query
def nested_round_trip(spark, sf_dir):
    return features.explode_nested(features.nested_ngrams(corpus(spark, sf_dir), 1, "unigrams"), "unigrams")


ORACLES["nested_round_trip"] = ORACLES["unigrams"]


@query
def chunked_wordcounts(spark, sf_dir):
    return features.chunked_counts(corpus(spark, sf_dir), 100)


ORACLES["chunked_wordcounts"] = f"""
WITH {_P}, s AS (SELECT *, len(t) AS n, CASE WHEN (len(t) % 100) * 3 < 200 THEN len(t) % 100 + 100 ELSE len(t) % 100 END AS ov FROM p),
c AS (SELECT "nc:id", CASE WHEN i - 1 < ov // 2 THEN 0 ELSE least((n - ov) // 100 + 1, (i - 1 - ov // 2) // 100 + 1) END AS chunk, t[i] AS token FROM s)
SELECT "nc:id", CAST(chunk AS BIGINT) AS chunk, token, count(*) AS count FROM c GROUP BY ALL
"""


@query
def word_share(spark, sf_dir):
    return features.word_share(corpus(spark, sf_dir), "the").withColumn("share", F.round("share", 9))


ORACLES["word_share"] = f"""WITH {_T} SELECT "nc:id", CAST(len(t) AS BIGINT) AS total, CAST(len(list_filter(t, lambda x: x = 'the')) AS BIGINT) AS hits, round(len(list_filter(t, lambda x: x = 'the')) / len(t), 9) AS share FROM t"""


@query
def top_ngrams(spark, sf_dir):
    """A report: the fifty most frequent trigrams."""
    return features.top_ngrams(corpus(spark, sf_dir), 3, 50)


ORACLES["top_ngrams"] = f"""WITH {_P} SELECT t[i] AS word0, t[i + 1] AS word1, t[i + 2] AS word2, count(*) AS count FROM p WHERE i + 2 <= len(t) GROUP BY ALL ORDER BY count DESC, word0, word1, word2 LIMIT 50"""


@query
def capitalised_unigrams(spark, sf_dir):
    """String predicates on a feature: totals of words that begin with a capital."""
    grams = features.ngram_counts(corpus(spark, sf_dir), 1).filter(F.col("word0").rlike("^[A-Z]"))
    return grams.groupBy("word0").agg(F.sum("count").alias("count"))


ORACLES["capitalised_unigrams"] = f"""WITH {_P} SELECT t[i] AS word0, count(*) AS count FROM p WHERE regexp_matches(t[i], '^[A-Z]') GROUP BY ALL"""


@query
def count_invariants(spark, sf_dir):
    """Totals that must agree between features."""
    c = corpus(spark, sf_dir)
    words = features.document_lengths(c).agg(F.sum("nwords").alias("n"), F.sum(F.greatest(F.col("nwords") - 1, F.lit(0))).alias("m"))
    uni = features.ngram_counts(c, 1).agg(F.sum("count").alias("n"))
    bi = features.ngram_counts(c, 2).agg(F.sum("count").alias("n"))
    rows = [words.select(F.lit("words").alias("what"), "n"), uni.select(F.lit("unigrams").alias("what"), "n"), words.select(F.lit("pairs").alias("what"), F.col("m").alias("n")), bi.select(F.lit("bigrams").alias("what"), "n")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


ORACLES["count_invariants"] = f"""WITH {_T}, s AS (SELECT CAST(sum(len(t)) AS BIGINT) AS n, CAST(sum(greatest(len(t) - 1, 0)) AS BIGINT) AS m FROM t)
SELECT 'words' AS what, n FROM s UNION ALL SELECT 'unigrams', n FROM s UNION ALL SELECT 'pairs', m FROM s UNION ALL SELECT 'bigrams', m FROM s"""


# -- vectors -----------------------------------------------------------------------


@query
def srp(spark, sf_dir):
    """Vectors and sign bits; no SQL for the projection, tested against a plain version."""
    v = vectors.random_projection(corpus(spark, sf_dir))
    return v.select("`nc:id`", F.size("SRP").cast("long").alias("dims"), F.round(F.aggregate("SRP", F.lit(0.0), lambda s, x: s + x.cast("double")), 2).alias("total"), F.hex("SRP_bits").alias("bits"))


@query
def hamming_pairs(spark, sf_dir):
    """Pairs of embeddings whose signs differ in at most sixteen places, equal signs as one class."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.sign_words("embedding", 64).alias("words"))
    return vectors.close_pairs(e, "vec_id", "words", 64, 16)


@query
def signature_classes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.sign_words("embedding", 64).alias("words"))
    return vectors.signature_classes(e, "vec_id", "words")


_SIGNS = """s AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding[1:64]] AS b FROM embeddings), c AS (SELECT b, min(vec_id) AS vec_id FROM s GROUP BY b)"""
ORACLES["hamming_pairs"] = f"""
WITH {_SIGNS}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum([CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS BIGINT) AS distance FROM c x JOIN c y ON x.vec_id < y.vec_id)
SELECT * FROM p WHERE distance <= 16"""
ORACLES["signature_classes"] = f"""WITH {_SIGNS} SELECT s.vec_id, c.vec_id AS class FROM s JOIN c USING (b)"""


# -- catalog -----------------------------------------------------------------------


@query
def freq_dict_encode(spark, sf_dir):
    return catalog.frequency_dictionary(table(spark, sf_dir, "orders"), "o_orderpriority")


ORACLES["freq_dict_encode"] = """SELECT row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS o_orderpriority__id, o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""


@query
def dictionary_encoded_rows(spark, sf_dir):
    return catalog.dictionary_encode(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


ORACLES["dictionary_encoded_rows"] = """
WITH d AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS lang__id FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT doc_id, lang__id FROM documents LEFT JOIN d USING (lang)"""


@query
def column_quantiles(spark, sf_dir):
    return catalog.quantiles(table(spark, sf_dir, "orders"), "o_totalprice").withColumn("value", F.round("value", 6))


ORACLES["column_quantiles"] = """
SELECT q, round(value, 6) AS value FROM (SELECT unnest([0.0::DOUBLE, 0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995, 1.0]) AS q,
       unnest(quantile_cont(o_totalprice, [0.0, 0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995, 1.0])) AS value FROM orders)"""


@query
def date_bounds(spark, sf_dir):
    """Quantiles of a type without arithmetic: the bounds."""
    return catalog.quantiles(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day")


ORACLES["date_bounds"] = """SELECT 0.0::DOUBLE AS q, CAST(min(o_orderdate) AS DATE) AS value FROM orders UNION ALL SELECT 1.0::DOUBLE, CAST(max(o_orderdate) AS DATE) FROM orders"""


@query
def column_cardinality(spark, sf_dir):
    return catalog.cardinality(table(spark, sf_dir, "metadata"), ["@id", "htid", "pubdate", "author"])


ORACLES["column_cardinality"] = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT "{c}") + max(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) AS distinct, count(*) AS total FROM metadata""" for c in ("@id", "htid", "pubdate", "author"))
ORACLES["column_cardinality"] = ORACLES["column_cardinality"].replace("AS distinct,", 'AS "distinct",')


@query
def column_top_values(spark, sf_dir):
    """A report: the ten most frequent schools."""
    return catalog.top_values(table(spark, sf_dir, "dissertations"), "school")


ORACLES["column_top_values"] = "SELECT school AS value, count(*) AS count FROM dissertations WHERE school IS NOT NULL GROUP BY school ORDER BY count DESC, value LIMIT 10"


@query
def inferred_forms(spark, sf_dir):
    """Form and type of each column of three tables read as text."""
    rows = []
    for name, id in (("orders", "o_orderkey"), ("metadata", "@id"), ("dissertations", "filename")):
        t = table(spark, sf_dir, name)
        if name == "orders":
            t = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
        rows += [(name, f.name, f.form, f.spark_type) for f in catalog.infer_forms(t, id).values()]
    return spark.createDataFrame(rows, "source string, name string, form string, type string")  # a row per column


@query
def integer_predicate(spark, sf_dir):
    """What the integer form asks of each value, on text columns."""
    t = table(spark, sf_dir, "orders")
    return t.agg(*[F.bool_and(F.coalesce(catalog.integer_like(F.col(c).cast("string")), F.lit(True))).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")])


ORACLES["integer_predicate"] = "SELECT " + ", ".join(f"bool_and(coalesce(regexp_full_match(CAST({c} AS VARCHAR), '-?[0-9]{{1,19}}') AND TRY_CAST({c} AS BIGINT) IS NOT NULL, true)) AS {c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")) + " FROM orders"


@query
def date_predicate(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    return t.agg(*[F.round(catalog.date_share(F.col(c)), 6).alias(c) for c in ("day", "o_orderstatus")])


ORACLES["date_predicate"] = "SELECT round(avg(CASE WHEN regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '[0-9]{3,4}-[0-1]?[0-9]-[0-3]?[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS day, round(avg(CASE WHEN regexp_matches(o_orderstatus, '[0-9]{3,4}-[0-1]?[0-9]-[0-3]?[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS o_orderstatus FROM orders"


@query
def typed_catalog(spark, sf_dir):
    """The orders read as text, brought to their forms."""
    t = table(spark, sf_dir, "orders")
    t = t.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    out = catalog.typed(t, catalog.infer_forms(t, "o_orderkey"))
    return out.withColumn("o_custkey", F.col("o_custkey").cast("long"))


ORACLES["typed_catalog"] = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


@query
def years_in_titles(spark, sf_dir):
    return table(spark, sf_dir, "metadata").select("`@id`", "title", extract_year("title").alias("year"))


ORACLES["years_in_titles"] = """SELECT "@id", title, TRY_CAST(nullif(regexp_extract(title, '([0-9]{4})', 1), '') AS SMALLINT) AS year FROM metadata"""


@query
def wrapped_arrays(spark, sf_dir):
    """Single values and arrays in one column: the keywords of the raw lines."""
    whole = table(spark, sf_dir, "dissertation_files").filter(F.try_parse_json("line").isNotNull())
    lines = whole.select("feed", "file_no", "line_no", F.get_json_object("line", "$.keywords").alias("keywords")).filter("keywords is not null")
    wrapped = catalog.wrap_arrays(lines, ["keywords"])
    return wrapped.select("feed", "file_no", "line_no", F.size("keywords").cast("long").alias("n"))


ORACLES["wrapped_arrays"] = """
WITH k AS (SELECT feed, file_no, line_no, json_extract(line, '$.keywords') AS k FROM dissertation_files WHERE json_valid(line))
SELECT feed, file_no, line_no, CAST(CASE WHEN json_type(k) = 'ARRAY' THEN json_array_length(k) ELSE 1 END AS BIGINT) AS n FROM k WHERE json_type(k) IS NOT NULL AND json_type(k) <> 'NULL'"""


def _flat(spark, sf_dir):
    t = table(spark, sf_dir, "dissertations").groupBy("filename").agg(F.min_by(F.struct("school", "keywords", "completionyear", "hasdecadenamed", "dissertation"), F.struct("loaded_at", "dissertation", "advisor")).alias("r")).select("filename", "r.*")
    numbered = t.withColumn("nc:id", F.col("filename").cast("long")).drop("filename")
    forms = catalog.infer_forms(numbered)
    forms["school"].form = "dictionary"  # also in the smallest table, where most rows have a school of their own
    return catalog.flat_catalog(numbered, forms)


@query
def flat_catalog_fast(spark, sf_dir):
    return _flat(spark, sf_dir)["fastcat"].withColumn("completionyear", F.col("completionyear").cast("long")).select("`nc:id`", "school__id", "completionyear", "hasdecadenamed")


@query
def flat_catalog_readable(spark, sf_dir):
    return _flat(spark, sf_dir)["catalog"].withColumn("completionyear", F.col("completionyear").cast("long"))


@query
def flat_catalog_list(spark, sf_dir):
    return _flat(spark, sf_dir)["keywords"]


@query
def flat_catalog_lookup(spark, sf_dir):
    return _flat(spark, sf_dir)["schoolLookup"]


_FLAT = """r AS (SELECT filename, min_by({'school': school, 'keywords': keywords, 'completionyear': completionyear, 'hasdecadenamed': hasdecadenamed, 'dissertation': dissertation}, (loaded_at, dissertation, advisor)) AS r FROM dissertations GROUP BY filename),
c AS (SELECT CAST(filename AS BIGINT) AS "nc:id", r.* FROM (SELECT filename, unnest(r) FROM r) r),
k AS (SELECT school, row_number() OVER (ORDER BY count(*) DESC, school) - 1 AS school__id FROM c WHERE school IS NOT NULL GROUP BY school)"""
_FLAT = _FLAT.replace("r.* FROM (SELECT filename, unnest(r) FROM r) r", "r.school, r.keywords, r.completionyear, r.hasdecadenamed, r.dissertation FROM r")
ORACLES["flat_catalog_fast"] = f"""WITH {_FLAT} SELECT "nc:id", school__id, completionyear, hasdecadenamed FROM c LEFT JOIN k USING (school)"""
ORACLES["flat_catalog_readable"] = f"""WITH {_FLAT} SELECT "nc:id", school, completionyear, hasdecadenamed, dissertation FROM c"""
ORACLES["flat_catalog_list"] = f"""WITH {_FLAT} SELECT "nc:id", unnest(keywords) AS keywords FROM c"""
ORACLES["flat_catalog_lookup"] = f"""WITH {_FLAT} SELECT school__id, school FROM k"""


# -- keys, joins, slices -------------------------------------------------------------


@query
def catalog_ids(spark, sf_dir):
    """Ids numbered in their order."""
    t = table(spark, sf_dir, "metadata").select("`@id`").distinct()
    return catalog.assign_ids(t, "@id")


ORACLES["catalog_ids"] = """SELECT "@id", row_number() OVER (ORDER BY "@id") - 1 AS "nc:id" FROM (SELECT DISTINCT "@id" FROM metadata)"""


@query
def repeated_ids(spark, sf_dir):
    return catalog.duplicate_ids(table(spark, sf_dir, "metadata"), "@id")


ORACLES["repeated_ids"] = """SELECT "@id", count(*) AS count FROM metadata GROUP BY "@id" HAVING count(*) > 1"""


@query
def stack_assignment(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.groupBy(catalog.stack_of(64).alias("stack")).agg(F.count("*").alias("documents"))


ORACLES["stack_assignment"] = "SELECT doc_id // 64 AS stack, count(*) AS documents FROM documents GROUP BY ALL"


@query
def first_wins_dedup(spark, sf_dir):
    """The first text of each id."""
    t = table(spark, sf_dir, "texts").filter("`@id` is not null").withColumn("shown", F.coalesce("text", F.lit("")))
    return catalog.first_wins(t, "@id", ["nc:id", "shown"]).select("`@id`", "`nc:id`", "shown")


ORACLES["first_wins_dedup"] = """SELECT "@id", min("nc:id") AS "nc:id", min(coalesce(text, '')) AS shown FROM texts WHERE "@id" IS NOT NULL GROUP BY "@id" """


@query
def text_by_id(spark, sf_dir):
    """Catalog and texts by id, texts or not."""
    m = table(spark, sf_dir, "metadata").select("`@id`", "title").distinct()
    t = table(spark, sf_dir, "texts").select("`@id`", F.length("text").cast("long").alias("chars")).distinct()
    return m.join(t, "@id", "left")


ORACLES["text_by_id"] = """SELECT m."@id", title, chars FROM (SELECT DISTINCT "@id", title FROM metadata) m LEFT JOIN (SELECT DISTINCT "@id", CAST(length(text) AS BIGINT) AS chars FROM texts) t ON t."@id" = m."@id" """


@query
def feature_with_metadata(spark, sf_dir):
    """A feature beside the catalog, by key."""
    lengths = features.document_lengths(corpus(spark, sf_dir))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nc:id"), "lang")
    return lengths.join(d, "nc:id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("nwords").alias("words"))


ORACLES["feature_with_metadata"] = r"""SELECT lang, count(*) AS documents, CAST(sum(len(regexp_split_to_array(text, '[^\p{L}]'))) AS BIGINT) AS words FROM documents GROUP BY lang"""


@query
def metadata_get(spark, sf_dir):
    """Point lookup, pushed to the scan."""
    return table(spark, sf_dir, "metadata").filter(F.col("`@id`") == "100007").select("`@id`", "title", "author")


ORACLES["metadata_get"] = """SELECT "@id", title, author FROM metadata WHERE "@id" = '100007'"""


@query
def only_stacks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nc:id"), "n_chars").withColumn("stack", catalog.stack_of(64))
    return docs.filter(F.col("stack").isin(1, 3))


ORACLES["only_stacks"] = """SELECT doc_id AS "nc:id", n_chars, doc_id // 64 AS stack FROM documents WHERE doc_id // 64 IN (1, 3)"""


@query
def id_distances(spark, sf_dir):
    return catalog.id_distances(table(spark, sf_dir, "customer"), "c_name")


ORACLES["id_distances"] = """
WITH l AS (SELECT c_name AS id, lag(c_name) OVER (ORDER BY c_name) AS p FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL))
SELECT id, CAST(coalesce(list_max(list_filter(range(0, least(length(id), length(p)) + 1), lambda i: id[1:i] = p[1:i])), 0) AS BIGINT) AS distance FROM l"""


@query
def id_chunks(spark, sf_dir):
    """Chunks of ids by shared prefixes: a recursion, tested against a plain version."""
    return catalog.chunk_ids(table(spark, sf_dir, "customer"), "c_name", 64, 1024)


@query
def prefix_lengths(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", common_prefix("n_name", F.lit("IRAN")).alias("shared"))


ORACLES["prefix_lengths"] = "SELECT n_name, CAST(list_max(list_filter(range(0, least(length(n_name), 4) + 1), lambda i: n_name[1:i] = 'IRAN'[1:i])) AS BIGINT) AS shared FROM nation"


@query
def stored_tokenization(spark, sf_dir):
    """The texts tokenized here against the tokenization delivered."""
    here = table(spark, sf_dir, "texts").select("`@id`", tokenize("text").alias("here")).distinct()
    there = table(spark, sf_dir, "tokenization").select("`@id`", F.col("tokenization").alias("there")).distinct()
    same = F.coalesce(F.col("here") == F.col("there"), F.col("here").isNull() & F.col("there").isNull())
    return here.join(there, "@id").groupBy(same.alias("same")).agg(F.count("*").alias("texts"))


ORACLES["stored_tokenization"] = r"""
WITH h AS (SELECT DISTINCT "@id", regexp_split_to_array(text, '[^\p{L}]') AS here FROM texts), t AS (SELECT DISTINCT "@id", tokenization AS there FROM tokenization)
SELECT here IS NOT DISTINCT FROM there AS same, count(*) AS texts FROM h JOIN t USING ("@id") GROUP BY ALL"""
