"""Queries of sources and sinks: a table is written in a form, read back, and compared with SQL over the table itself.

What is written goes to a folder of its own below the checkpoint folder, which
all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.corpus import Corpus, Options
from lexmill.operators import catalog, features, vectors
from lexmill.plans.reference import corpus
from lexmill.plans.tables import table
from lexmill.session import checkpoint_dir
from lexmill.sources import catalogs, files, sinks, texts

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _place(spark: SparkSession, name: str) -> str:
    return files.join(checkpoint_dir(spark), f"query-{uuid.uuid4().hex}", name)


# -- texts -----------------------------------------------------------------------


@query
def folder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each of the 25 nations, an empty one among them, in folders by region; the id is the file's name."""
    root = _place(spark, "texts")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        shown = "" if r["n_name"] == "CHINA" else f"{r['n_name'].lower()} lies in region {r['n_regionkey']}"
        files.write_text(files.join(root, f"region {r['n_regionkey']}", f"{r['n_name']}.txt"), shown, spark)
    return texts.read_texts(spark, root)


ORACLES["folder_texts"] = """SELECT n_name AS "@id", CASE WHEN n_name = 'CHINA' THEN '' ELSE lower(n_name) || ' lies in region ' || n_regionkey END AS text FROM nation"""


@query
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per line, cut at the first tab."""
    path = _place(spark, "lines")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.regexp_replace("text", "[\r\n]", " "))).write.text(path)
    return texts.read_lines(spark, path)


ORACLES["lines_round_trip"] = r"""SELECT CAST(doc_id AS VARCHAR) AS "@id", regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL"""


@query
def stack_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and metadata in Parquet stacks: texts come from two columns, metadata from those that aren't features."""
    path = _place(spark, "stacks")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("@id"), F.col("doc_id").alias("nc:id"), "lang", F.col("text").alias("nc:text"))
    sinks.write_stacks(docs, path, 64)
    stacks = texts.read_stacks(spark, path)
    read = texts.stack_texts(stacks).select("`@id`", F.length("text").cast("long").alias("chars"))
    return texts.stack_metadata(stacks).drop("stack").join(read, "@id")


ORACLES["stack_texts"] = """SELECT CAST(doc_id AS VARCHAR) AS "@id", doc_id AS "nc:id", lang, CAST(length(text) AS BIGINT) AS chars FROM documents"""


@query
def corpus_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus over a catalog that holds its texts: catalog typed and stored, a feature stored and read back by id."""
    root = _place(spark, "corpus")
    path = files.join(root, "catalog.ndjson")
    table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "text").write.json(path)
    c = Corpus(spark, files.join(root, "built"), metadata=path, cache=frozenset({"document_lengths"}), options=Options(metadata_field="text", batch_size=256))
    c.feature("document_lengths")
    return c.feature("document_lengths", ids="@id")


ORACLES["corpus_lengths"] = r"""SELECT CAST(doc_id AS VARCHAR) AS "@id", CAST(len(regexp_split_to_array(text, '[^\p{L}]')) AS BIGINT) AS nwords FROM documents"""


# -- catalogs ----------------------------------------------------------------------


@query
def ndjson_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON in which lists of one element are single values: they come back as lists."""
    path = _place(spark, "c.ndjson")
    t = table(spark, sf_dir, "split_a").filter("id is not null")
    lines = t.select(F.when(F.size("labels") == 1, F.to_json(F.struct("id", "`nc:text`", F.col("labels")[0].alias("labels")))).otherwise(F.to_json(F.struct("id", "`nc:text`", "labels"))))
    lines.write.text(path)
    return catalogs.read_ndjson(spark, path).select("id", "`nc:text`", F.array_join("labels", "|").alias("labels"))


ORACLES["ndjson_catalog"] = """SELECT id, "nc:text", array_to_string(labels, '|') AS labels FROM split_a WHERE id IS NOT NULL"""


@query
def csv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "c.csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    c = catalogs.read_catalog(spark, path, "csv")
    return c.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


ORACLES["csv_catalog"] = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer"


@query
def tsv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "c.tsv")
    table(spark, sf_dir, "part").write.option("header", True).option("sep", "\t").csv(path)
    return catalogs.read_catalog(spark, path, "tsv").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", F.col("p_size").cast("long").alias("p_size"))


ORACLES["tsv_catalog"] = "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part"


@query
def feather_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations in two Feather files, names as a dictionary and keys unsigned."""
    import pyarrow as pa

    root = _place(spark, "c.feather")
    t = table(spark, sf_dir, "nation").toArrow()  # 25 rows at every scale
    t = pa.table({"n_name": t["n_name"].cast(pa.string()).combine_chunks().dictionary_encode(), "n_regionkey": t["n_regionkey"].cast(pa.uint32())})
    for i, part in enumerate((t.slice(0, 10), t.slice(10))):
        out = pa.BufferOutputStream()
        with pa.ipc.new_file(out, part.schema) as writer:
            writer.write_table(part)
        files.write_bytes(files.join(root, f"{i}.feather"), out.getvalue().to_pybytes(), spark)
    return catalogs.read_catalog(spark, root, "feather")


ORACLES["feather_catalog"] = "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query
def messy_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet files of one table that don't agree about a column's type: that of most files holds."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.year("o_orderdate").cast("long").alias("year"))
    paths = []
    for status, kind in (("F", "bigint"), ("O", "int"), (None, "bigint")):
        paths.append(_place(spark, "part"))
        own = F.col("o_orderstatus") == status if status else F.coalesce(~F.col("o_orderstatus").isin("F", "O"), F.lit(True))
        t.filter(own).withColumn("o_orderkey", F.col("o_orderkey").cast(kind)).write.parquet(paths[-1])
    return catalogs.read_messy_parquet(spark, paths)


ORACLES["messy_parquet"] = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders"


@query
def schema_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column's type after its schema was written as text and read again."""
    rows = []
    for name in ("dissertations", "tokenization", "events", "embeddings"):
        path = files.join(_place(spark, "schema"), f"{name}.yaml")
        catalogs.write_schema(spark, path, table(spark, sf_dir, name).schema)
        rows += [(name, f.name, f.dataType.simpleString()) for f in catalogs.read_schema(spark, path)]
    return spark.createDataFrame(rows, "source string, name string, type string")  # a row per column


# -- stored features ---------------------------------------------------------------


@query
def stack_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog and document-level features in one table by stack, some columns of it read back."""
    path = _place(spark, "export")
    c = corpus(spark, sf_dir)
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nc:id"), "lang")
    sinks.write_stacks(sinks.export(held, {"document_lengths": features.document_lengths(c)}), path, 128)
    return sinks.read_written(spark, path, columns=["nc:id", "lang", "nc:nwords", "stack"]).withColumn("stack", F.col("stack").cast("long"))


ORACLES["stack_export"] = r"""SELECT doc_id AS "nc:id", lang, CAST(len(regexp_split_to_array(text, '[^\p{L}]')) AS BIGINT) AS "nc:nwords", doc_id // 128 AS stack FROM documents"""


@query
def built_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions added one by one, two to a file."""
    path = _place(spark, "built")
    with sinks.StackBuilder(spark, path, table(spark, sf_dir, "region").select(F.col("r_name").alias("@id"), F.col("r_name").alias("nc:text")).schema, max_docs_in_file=2) as b:
        for r in table(spark, sf_dir, "region").collect():  # five rows at every scale
            b.add({"@id": r["r_name"]}, text=f"text of {r['r_name']}")
    return texts.stack_texts(texts.read_stacks(spark, path))


ORACLES["built_stacks"] = """SELECT r_name AS "@id", 'text of ' || r_name AS text FROM region"""


@query
def ids_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids each stack file holds."""
    path = _place(spark, "stacks")
    sinks.write_stacks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("@id"), F.col("doc_id").alias("nc:id")), path, 500)
    return texts.ids_by_file(texts.read_stacks(spark, path)).groupBy(F.regexp_extract("file", r"stack=(\d+)", 1).cast("long").alias("stack")).agg(F.count("*").alias("ids"))


ORACLES["ids_by_file"] = "SELECT doc_id // 500 AS stack, count(*) AS ids FROM documents GROUP BY ALL"


@query
def exported_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, vector and sign bits stored by a job, read back."""
    path = _place(spark, "srp")
    vectors.write_vectors(corpus(spark, sf_dir), path, 320)
    return spark.read.parquet(path).select("`nc:id`", F.size("SRP").cast("long").alias("dims"), F.length("SRP_bits").cast("long").alias("bytes"))


ORACLES["exported_vectors"] = """SELECT doc_id AS "nc:id", 320::BIGINT AS dims, 40::BIGINT AS bytes FROM documents"""


# -- pairs, words outside the vocabulary, whole catalog ------------------------------


@query
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the twenty nearest pairs of signatures, with what the catalog says of both."""
    e = table(spark, sf_dir, "embeddings")
    pairs = vectors.close_pairs(e.select("vec_id", vectors.sign_words("embedding", 64).alias("words")), "vec_id", "words", 64, 16)
    about = e.select(F.col("vec_id").alias("a"), F.col("label").alias("label_a"))
    return vectors.nearest_pairs(pairs, about, 20)


ORACLES["nearest_pairs"] = """
WITH s AS (SELECT vec_id, label, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding[1:64]] AS b FROM embeddings), c AS (SELECT b, min(vec_id) AS vec_id FROM s GROUP BY b),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum([CASE WHEN x.b[i] <> y.b[i] THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS BIGINT) AS distance FROM c x JOIN c y ON x.vec_id < y.vec_id)
SELECT p.a, p.b, p.distance, s.label AS label_a, t.label AS label_b FROM p JOIN s ON s.vec_id = p.a JOIN s t ON t.vec_id = p.b WHERE distance <= 16 ORDER BY distance, a, b LIMIT 20"""


def _capped(name: str, n: int, cap: int) -> None:
    """Counts by ids of a vocabulary cut to its first ``cap`` words: rows with words outside it stay, with null ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        return features.encode(features.ngram_counts(c, n), features.vocabulary(c, cap), n)

    from lexmill.plans.reference import encoded_sql

    QUERIES[name], ORACLES[name] = run, encoded_sql(n, cap)


_capped("capped_unigrams", 1, 1000)
_capped("capped_bigrams", 2, 1000)

_CATALOG = ["filename", "dir_abbrev", "lastname", "first_middle", "middlename", "suffix", "dissertation", "advisor", "altadvisor", "name", "searchstring", "school", "completionyear", "year", "start_year", "end_year", "middle_year", "span_length", "hasdecadenamed", "gender"]
_ORDER = ["dissertation", "advisor", "altadvisor", "name", "school", "searchstring", "gender"]


@query
def flat_catalog_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the catalog, in the forms found for them; the readable relation, first delivery of each record."""
    t = table(spark, sf_dir, "dissertations")
    first = F.struct("loaded_at", *[F.coalesce(c, F.lit("")).alias(c) for c in _ORDER])
    t = t.groupBy("filename").agg(F.min_by(F.struct(*[c for c in _CATALOG if c != "filename"], "keywords"), first).alias("r")).select("filename", "r.*")
    numbered = t.withColumn("nc:id", F.col("filename").cast("long"))
    out = catalog.flat_catalog(numbered, catalog.infer_forms(numbered, "filename"))["catalog"]
    whole = [c for c, kind in out.dtypes if kind in ("tinyint", "smallint", "int")]
    return out.withColumns({c: F.col(c).cast("long") for c in whole}).withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind in ("float", "double", "date")})


ORACLES["flat_catalog_whole"] = f"""
WITH r AS (SELECT filename, min_by({{{', '.join(f"'{c}': {c}" for c in _CATALOG if c != 'filename')}}}, (loaded_at, {', '.join(f"coalesce({c}, '')" for c in _ORDER)})) AS r FROM dissertations GROUP BY filename)
SELECT CAST(filename AS BIGINT) AS "nc:id", filename, {', '.join(f'r.{c}' for c in _CATALOG if c != 'filename')} FROM r"""
