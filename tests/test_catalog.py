import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import catalog
from tests.conftest import rows

SCHEMA = "id string, small string, big string, plus string, real double, day string, kind string, flag boolean, none string, tags array<string>, years array<string>, st struct<x:int>"


def table(spark, n=40):
    data = [(str(i), str(i % 5), str(i * 10**10), "+1", i / 2, "1900-1-2" if i else "x", "ab"[i % 2], i % 2 == 0, None, ["a", "b"] if i else None, [str(1900 + i)], (i,)) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA)


def test_forms(spark):
    forms = catalog.infer_forms(table(spark), "id")
    got = {f.name: (f.form, f.spark_type) for f in forms.values()}
    assert got["id"] == ("id", "string") and got["small"] == ("integer", "tinyint") and got["big"] == ("integer", "bigint")
    assert got["plus"][0] == "dictionary" and got["real"] == ("float", "double") and got["day"] == ("date", "date")
    assert got["kind"][0] == "dictionary" and got["flag"] == ("boolean", "boolean") and got["none"][0] == "empty"
    assert got["tags"] == ("string", "array<string>") and got["years"] == ("integer", "array<smallint>") and got["st"][0] == "raw"
    assert catalog.infer_forms(table(spark), "id", bool_as_int=True)["flag"].form == "integer"


def test_typed_values_and_metadata(spark):
    df = table(spark)
    forms = catalog.describe(df, catalog.infer_forms(df, "id"))
    out = catalog.typed(df, forms)
    r = out.orderBy(F.col("id").cast("int")).collect()
    assert r[0]["day"] is None and r[1]["day"] == dt.date(1900, 1, 2) and r[3]["years"] == [1903] and r[2]["small"] == 2
    assert "quantiles" in out.schema["small"].metadata and "top_values" in out.schema["kind"].metadata


def test_integer_like_is_strict(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "-7", "+5", " 12", "1.0", "9223372036854775808", "")], "x string")
    assert [r[0] for r in df.select(catalog.integer_like(F.col("x"))).collect()] == [True, True, False, False, False, False, False]


def test_dictionary_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in catalog.frequency_dictionary(df, "v").orderBy("v__id").collect()] == [(0, "a", 2), (1, "b", 2), (2, "c", 1)]
    assert catalog.dictionary_encode(df, "v").filter("v__id is null").count() == 1
    assert [catalog.code_type(n) for n in (127, 128, 32768)] == ["tinyint", "smallint", "int"]


def test_ids(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "filename string, x long")
    assert catalog.infer_id_field(df) == "filename"
    assert rows(catalog.assign_ids(df).select("`@id`", "`nc:id`")) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="unique"):
        catalog.assign_ids(df.unionByName(df))
    with pytest.raises(ValueError):
        catalog.infer_id_field(df.drop("filename"))


def test_wrap_arrays(spark):
    df = spark.createDataFrame([("a",), ('["b","c"]',), (None,), ("[x",)], "labels string")
    assert [r[0] for r in catalog.wrap_arrays(df, ["labels"]).collect()] == [["a"], ["b", "c"], None, ["[x"]]


def test_flat_catalog_joins_back(spark):
    df = table(spark).withColumn("nc:id", F.col("id").cast("long"))
    parts = catalog.flat_catalog(df.drop("st"), catalog.infer_forms(df.drop("st"), "id"))
    assert {"fastcat", "catalog", "tags", "years", "kindLookup"} <= set(parts)
    back = parts["fastcat"].join(parts["kindLookup"], "kind__id", "left").select("`nc:id`", "kind")
    assert rows(back) == rows(df.select("`nc:id`", "kind"))
    assert parts["tags"].count() == 78


def splits_by_hand(d, low, high):
    if len(d) <= high or len(d) <= 2 * low:
        return [len(d)]
    at = min(range(low, len(d) - low), key=lambda i: (d[i], i))
    return splits_by_hand(d[:at], low, high) + splits_by_hand(d[at:], low, high)


def test_split_points():
    d = [0, 3, 2, 5, 1, 4, 1, 6, 2, 2, 0, 7]
    starts = catalog.split_points(d, 2, 4)
    sizes = [b - a for a, b in zip(starts, starts[1:] + [len(d)])]
    assert sizes == splits_by_hand(d, 2, 4)


def test_id_chunks(spark):
    ids = [f"a{i:02d}" for i in range(20)] + [f"b{i:02d}" for i in range(20)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,), ("a00",)], "k string")
    got = dict(rows(catalog.chunk_ids(df, "k", 4, 25)))
    assert len(got) == 40 and {got[i] for i in ids[:20]} == {0} and {got[i] for i in ids[20:]} == {1}
    assert dict(rows(catalog.id_distances(df, "k")))["b00"] == 0


def test_quantiles_of_other_types(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,)], "s string")
    assert rows(catalog.quantiles(df, "s")) == [(0.0, "a"), (1.0, "c")]
    assert rows(catalog.cardinality(df, ["s"])) == [("s", 3, 3)]


def test_nulls_do_not_keep_a_column_from_being_whole_numbers(spark):
    df = spark.createDataFrame([("1", 1600, "5", [1, None]), ("2", None, None, None), ("3", 1949, "70000", [2])], "id string, y long, s string, l array<long>")
    forms = catalog.infer_forms(df, "id")
    assert [(forms[c].form, forms[c].spark_type) for c in ("y", "s", "l")] == [("integer", "smallint"), ("integer", "int"), ("integer", "array<tinyint>")]
