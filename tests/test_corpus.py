import gzip
import json

import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill import cli
from lexmill.corpus import Corpus, Options
from lexmill.sources import catalogs, files, sinks, texts
from lexmill.streaming.incremental import document_stream, running_counts
from tests.conftest import rows

THREE = {"a": "A word. A word, a word.", "b": "", "г": "Слово и слово"}


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "texts"
    (d / "deep").mkdir(parents=True)
    for i, (k, v) in enumerate(THREE.items()):
        (d / ("deep" if i == 2 else ".") / f"{k}.txt").write_text(v, encoding="utf-8")
    return d


def test_folder_keeps_empty_files(spark, folder):
    (folder / "z.txt.gz").write_bytes(gzip.compress("packed".encode()))
    (folder / "x.md").write_text("not this")
    assert dict(rows(texts.read_folder(spark, str(folder)))) == THREE | {"z": "packed"}


def test_lines_first_wins(spark, tmp_path):
    p = tmp_path / "docs.txt"
    p.write_text("a\tone\ttwo\nno tab\nb\t\na\tagain\n")
    assert rows(texts.read_lines(spark, str(p))) == [("a", "one\ttwo"), ("b", "")]


def test_ndjson_with_mixed_arrays(spark, tmp_path):
    p = tmp_path / "c.ndjson"
    p.write_text("\n".join(json.dumps(x) for x in ({"id": "1", "labels": "a"}, {"id": "2", "labels": ["b", "c"]}, {"id": "3", "n": 1}, {"id": "4", "n": "NA"})))
    df = catalogs.read_catalog(spark, str(p))
    assert [r["labels"] for r in df.orderBy("id").collect()] == [["a"], ["b", "c"], None, None]
    with pytest.raises(ValueError, match="n"):
        catalogs.read_ndjson(spark, str(p), strict=True)


def test_other_catalogs(spark, tmp_path):
    feather.write_feather(pa.table({"id": pa.array([1, 2], pa.uint32()), "k": pa.array(["x", "y"]).dictionary_encode()}), str(tmp_path / "c.feather"))
    df = catalogs.read_catalog(spark, str(tmp_path / "c.feather"))
    assert df.dtypes == [("id", "bigint"), ("k", "string")]
    (tmp_path / "c.csv").write_text("id,n\na,1\nb,2\n")
    (tmp_path / "c.tsv").write_text("id\tn\na\t1\n")
    assert rows(catalogs.read_catalog(spark, str(tmp_path / "c.csv"))) == [("a", 1), ("b", 2)]
    assert rows(catalogs.read_catalog(spark, str(tmp_path / "c.tsv"))) == [("a", 1)]
    with pytest.raises(NotImplementedError):
        catalogs.read_catalog(spark, "c.xlsx")


def test_messy_parquet(spark, tmp_path):
    for i, (t, v) in enumerate((("long", 1), ("long", 2), ("string", "3"))):
        spark.createDataFrame([(v,)], f"n {t}").coalesce(1).write.parquet(str(tmp_path / str(i)))
    files = [str(next((tmp_path / str(i)).glob("*.parquet"))) for i in range(3)]
    assert catalogs.survey_parquet(files)["n"]["int64"] == 2
    assert rows(catalogs.read_messy_parquet(spark, files)) == [(1,), (2,), (3,)]


def test_settings(tmp_path):
    (tmp_path / ".lexmill.yaml").write_text("# comment\nroot: 'x'\n")
    (tmp_path / "a").mkdir()
    assert catalogs.load_settings(str(tmp_path / "a")) == {"root": "x"}


def test_corpus_from_folder(spark, folder, tmp_path):
    c = Corpus(spark, str(tmp_path / "root"), texts=str(folder))
    assert c.metadata.tb.count() == 3 and rows(c.metadata.id_index()) == [("a", 0), ("b", 1), ("г", 2)]
    words = c.feature("document_lengths").agg(F.sum("nwords")).first()[0]
    assert words == c.feature("unigrams").agg(F.sum("count")).first()[0] == c.total_wordcounts.agg(F.sum("count")).first()[0]
    assert c.feature("encoded_bigrams").columns == ["nc:id", "word1", "word2", "count"]
    assert set(c.feature("bigrams", "@id").columns) == {"@id", "word0", "word1", "count"}
    assert c.get_document("a").full_text == THREE["a"] and c.get_document("a").tokenize()[:2] == ["A", "word"]
    assert c.get_document("none").metadata == {} and c.first().id == "a" and c.random(1).id in THREE
    assert len(list(c.documents())) == 3 and len(list(c.iter_over("document_lengths"))) == 3
    assert c.validate()["valid"]
    c.register_feature("upper", lambda c: c.texts().select("`nc:id`", F.upper("text").alias("upper")))
    c.to_parquet(str(tmp_path / "out"), ("text", "document_lengths", "upper"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {"@id", "nc:id", "nc:text", "nc:nwords", "nc:upper", "stack"} == set(back.columns)
    files = texts.ids_by_file(texts.read_stacks(spark, str(tmp_path / "out")))
    assert files.count() == 3 and all(r["file"].endswith(".parquet") for r in files.collect())
    again = Corpus(spark, str(tmp_path / "root2"), bookstacks=str(tmp_path / "out"))
    assert dict(rows(again.identified_texts().select("`@id`", "text"))) == THREE
    with pytest.raises(KeyError):
        c.feature("nothing")


def test_cache_is_written_once(spark, folder, tmp_path):
    c = Corpus(spark, str(tmp_path / "root"), texts=str(folder), cache=frozenset())
    c.cache("unigrams")
    before = sinks.fingerprint(str(tmp_path / "root" / "unigrams"))
    c.cache("unigrams").count()
    assert sinks.fingerprint(str(tmp_path / "root" / "unigrams")) == before and not (tmp_path / "root" / "bigrams").exists()


def test_corpus_from_catalog(spark, tmp_path):
    p = tmp_path / "c.ndjson"
    p.write_text("\n".join(json.dumps({"filename": str(i), "title": f"Title {i}", "year": 1900 + i, "keywords": ["a", "b"]}) for i in range(12)))
    c = Corpus(spark, str(tmp_path / "root"), metadata=str(p), options=Options(metadata_field="title", batch_size=5, exclude_fields=("year",)))
    assert c.metadata.tb.select("stack").distinct().count() == 3 and "year" not in c.metadata.tb.columns
    assert c.metadata.get("3")["title"] == "Title 3"
    only = Corpus(spark, str(tmp_path / "root"), metadata=str(p), only_stacks=[0], options=Options(metadata_field="title", batch_size=5))
    assert only.metadata.tb.count() == 5 and only.feature("document_lengths").count() == 5
    assert {"catalog", "fastcat", "keywords"} <= set(c.metadata.to_flat_catalog(str(tmp_path / "flat")))
    with pytest.raises(KeyError):
        Corpus(spark, str(tmp_path), metadata=str(p))
    with pytest.raises(ValueError):
        Corpus(spark, str(tmp_path), metadata=str(p), bookstacks="x")


def test_stale_catalog_is_made_anew(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("id,t\na,x\n")
    make = lambda: Corpus(spark, str(tmp_path / "root"), metadata=str(p), options=Options(metadata_field="t"))
    assert make().metadata.tb.count() == 1
    p.write_text("id,t\na,x\nb,y\n")
    assert make().metadata.tb.count() == 2


def test_stack_builder(spark, tmp_path):
    schema = T.StructType([T.StructField("@id", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("nc:text", T.StringType())])
    with sinks.StackBuilder(spark, str(tmp_path / "b"), schema, max_docs_in_file=2) as b:
        for i in range(5):
            b.add({"@id": str(i)}, text=f"t{i}")
        with pytest.raises(KeyError):
            b.add({}, other=1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5 and b.files == 3


def test_command_line(spark, folder, tmp_path, capsys):
    args = ["--dir", str(tmp_path / "cli"), "--texts", str(folder)]
    assert cli.main(["build", *args, "--targets", "document_lengths", "encodedunigrams"]) == 0
    assert sinks.is_complete(str(tmp_path / "cli" / "encoded_unigrams"))
    assert cli.main(["validate", *args]) == 0 and '"documents": 3' in capsys.readouterr().out


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "a")], "id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = running_counts(document_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert rows(spark.table("counted")) == [("a", 2), ("b", 1)]


def test_a_root_with_a_scheme(spark, folder):
    root = f"file://{folder.parent}/root"
    c = Corpus(spark, root, texts=f"file://{folder}", cache=frozenset({"document_lengths"}))
    assert dict(rows(c.feature("document_lengths", ids="@id"))) == {"a": 9, "b": 1, "г": 3}
    assert files.is_folder(f"{root}/metadata") and files.exists(f"{root}/metadata.source")
    written = files.files_below(f"{root}/document_lengths")
    assert Corpus(spark, root, texts=f"file://{folder}").metadata.tb.count() == 3 and files.files_below(f"{root}/document_lengths") == written
    assert files.join("hdfs://nn/a/", "b") == "hdfs://nn/a/b" and files.join("", "b") == "b" and files.join("/", "b") == "/b" and files.name_of("x://y/z/") == "z"
    assert files.files_below(f"{root}/nothing") == []


def test_schema_as_text():
    schema = T.StructType([T.StructField("@id", T.StringType()), T.StructField("a: b", T.ArrayType(T.LongType())), T.StructField("d", T.DecimalType(10, 2)), T.StructField("s", T.StructType([T.StructField("x", T.IntegerType())]))])
    assert catalogs.schema_from_text(catalogs.schema_to_text(schema)) == schema
    assert catalogs.schema_from_text("# old form\nyear:\n  arrow_type: int64\n  list: false\nkeys:\n  arrow_type: string\n  list: true\n").simpleString() == "struct<year:bigint,keys:array<string>>"
    assert catalogs.schema_from_text("") == T.StructType([])


def test_vectors_from_the_command_line(spark, folder):
    assert cli.main(["embed", "--dir", str(folder.parent / "e"), "--texts", str(folder), "--dims", "64"]) == 0
    got = spark.read.parquet(str(folder.parent / "e" / "SRP"))
    assert got.count() == 3 and {len(r["SRP"]) for r in got.collect()} == {64}


def test_another_tokenizer(spark, folder):
    c = Corpus(spark, str(folder.parent / "t"), texts=str(folder), options=Options(tokenizer="words"))
    assert dict(rows(c.feature("document_lengths", ids="@id")))["a"] == 9
    assert [r["word0"] for r in c.feature("unigrams").orderBy("word0").collect()][:2] == [",", "."]
    c = Corpus(spark, str(folder.parent / "u"), texts=str(folder), options=Options(tokenizer=lambda t: F.split(t, " ")))
    assert dict(rows(c.feature("document_lengths", ids="@id")))["a"] == 6
