import json

from lexmill.operators.drift import change_report, consistent_table, schema_changes, shape_paths, tagged_values
from tests.conftest import rows

LINES = "feed string, file_no long, file_name string, line_no long, arrived_at timestamp_ntz, line string"
NAMES = ["Brown, Ann", "Cole, Tom", "Dahl, Eva", "Engel, Max", "Faro, Ida", "Gold, Sam", "Hale, Joe", "Imre, Pal"]


def lines(spark, files):
    data = [(f, n, f"{f}/{n}", i, None, x if isinstance(x, str) else json.dumps(x)) for (f, n), objects in files.items() for i, x in enumerate(objects)]
    return spark.createDataFrame(data, LINES)


def changes(df):
    return rows(df.select("file_no", "change_kind", "field"))


def test_each_kind_of_change(spark):
    a = [{"id": str(i), "advisor": NAMES[i], "n": i, "gone": "x y"} for i in range(8)]
    b = [{"id": str(i + 8), "chair": NAMES[i], "n": str(i), "new": i % 2 == 0} for i in range(8)]
    c = [{"id": str(i + 16), "tutors": [NAMES[i]], "n": str(i), "new": i % 2 == 0} for i in range(8)]
    got = changes(schema_changes(lines(spark, {("f", 1): a, ("f", 2): b, ("f", 5): c})))
    assert got == sorted([(2, "renamed", "chair"), (2, "retyped", "n"), (2, "added", "new"), (2, "removed", "gone"), (5, "renamed", "tutors"), (5, "retyped", "tutors")], key=repr)


def test_missing_values_keep_the_last_type(spark):
    a = [{"n": 1}, {"n": 2}]
    b = [{"n": None}, {"n": ""}, {"n": "NA"}]
    c = [{"n": "x"}, {"n": "NA"}]
    assert changes(schema_changes(lines(spark, {("f", 1): a, ("f", 2): b, ("f", 3): c}))) == [(3, "retyped", "n")]


def test_broken_repeated_and_odd_lines(spark):
    df = lines(spark, {("f", 1): [{"a": 1}, '{"a": 1, "b', "", "[1]", "null"], ("f", 2): [{"a": 1, "A": 1}]})
    df = df.unionByName(df).withColumnRenamed("arrived_at", "key")
    assert changes(schema_changes(df)) == [(2, "added", "A")]


def test_most_values_decide(spark):
    a = [{"k": ["x"]}, {"k": ["y"]}, {"k": "z"}]
    b = [{"k": ["x"]}, {"k": "y"}, {"k": "z"}]
    assert changes(schema_changes(lines(spark, {("f", 1): a, ("f", 2): b}))) == [(2, "retyped", "k")]


def test_types_of_values(spark):
    got = tagged_values(lines(spark, {("f", 1): [{"s": "x", "i": 1, "f": 1.5, "b": True, "a": [1], "o": {"x": 1}, "n": None, "e": "", "na": "NA"}]}))
    assert dict((k, t) for k, t in rows(got.select("key", "type"))) == {"s": "string", "i": "integer", "f": "float", "b": "boolean", "a": "array", "o": "object", "n": None, "e": None, "na": None}


def test_empty_and_null(spark):
    assert changes(schema_changes(spark.createDataFrame([], LINES))) == []
    assert changes(schema_changes(spark.createDataFrame([(None, 1, None, 1, None, "{}"), ("f", None, None, None, None, None)], LINES))) == []


def test_one_table(spark):
    a = [{"id": str(i), "advisor": NAMES[i % 8], "n": i} for i in range(10)]
    b = [{"id": str(i + 8), "chair": {"last": NAMES[i].split(", ")[0], "first": NAMES[i].split(", ")[1]}, "n": str(i)} for i in range(8)]
    c = [{"id": str(i + 16), "chair": [NAMES[i]], "n": "x", "ID": True} for i in range(8)]
    table, report = consistent_table(lines(spark, {("f", 1): a, ("f", 2): b, ("f", 3): c}))
    assert {"ID", "id_2", "advisor", "advisor__object", "advisor__array", "n", "n__integer"} <= set(table.columns)
    got = {(r["file_no"], r["line_no"]): r for r in table.collect()}
    assert len(got) == 26 and all(got[k, i]["advisor"] == NAMES[i] for k in (1, 2, 3) for i in range(8))
    assert got[3, 0]["advisor__array"] == f'["{NAMES[0]}"]' and got[1, 0]["advisor__array"] is None
    assert report.filter("change_kind = 'renamed'").count() == 1
    assert consistent_table(spark.createDataFrame([], LINES))[0].count() == 0


def test_a_row_for_every_whole_line(spark):
    data = [("f", 1, "x", 1, None, x) for x in ('{"a": 1, "b": "p"}', '{"a": 2}', '{"a": 2}', "{}")]
    data += [("f", 2, "x", None, None, x) for x in ('{"a": 3, "b": "q"}', '{"a": 4}', "{", "{}")] + [("f", 3, "x", 1, None, "{}")]
    table, report = consistent_table(spark.createDataFrame(data, LINES))
    want = [(1, 1, 1, "p"), (1, 1, 2, None), (1, 1, None, None), (2, None, 3, "q"), (2, None, 4, None), (2, None, None, None), (3, 1, None, None)]
    assert rows(table.select("file_no", "line_no", "a", "b")) == sorted(want, key=repr)
    assert table.columns == ["feed", "file_no", "line_no", "a", "b"] and changes(report) == [(3, "removed", "a"), (3, "removed", "b")]
    assert consistent_table(spark.createDataFrame(data[-1:], LINES))[0].count() == 1


def test_a_file_of_lines_without_keys_is_compared(spark):
    got = changes(schema_changes(lines(spark, {("f", 1): [{"a": 1}], ("f", 2): [{}], ("f", 3): [{"a": 1}]})))
    assert got == [(2, "removed", "a"), (3, "added", "a")]


def test_paths_of_a_shape():
    assert shape_paths("STRING") == (("", "string"),) and shape_paths("DECIMAL(3,1)") == (("", "float"),)
    assert shape_paths("ARRAY<OBJECT<a: BIGINT, b c: ARRAY<STRING>, d: OBJECT<>>>") == (("", "array"), ("[]", "object"), ("[].a", "integer"), ("[].b c", "array"), ("[].b c[]", "string"), ("[].d", "object"))
    assert shape_paths("ARRAY<" * 5000 + "VOID" + ">" * 5000) == (("", "array"),)
    assert shape_paths("OBJECT<``: BIGINT, `q``>r`: OBJECT<`c, d`: BOOLEAN>>") == (("", "object"), (".", "integer"), (".q`>r", "object"), (".q`>r.c, d", "boolean"))
    assert shape_paths("OBJECT<`a:b`: VOID, x: VARIANT>") == (("", "object"), (".x", "mixed"))


def test_alternatives_and_inner_paths_are_reported(spark):
    a = [{"k": f"v {i}", "o": {"n": i, "t": {"y": i}}} for i in range(8)]
    b = [{"k": [f"v {i}"] if i % 4 == 0 else f"v {i}", "o": {"n": i, "t": {"y": i}}} for i in range(8)]
    c = [{"k": [f"v {i}"] if i % 4 == 0 else f"v {i}", "o": {"n": str(i), "t": {"y": i, "new": [1]}}} for i in range(8)]
    d = [{"k": f"v {i}", "o": {"n": str(i), "t": {"new": [1]}}} for i in range(8)]
    df = lines(spark, {("f", 1): a, ("f", 2): b, ("f", 3): c, ("f", 4): d})
    assert changes(schema_changes(df)) == []
    got = rows(change_report(df).select("file_no", "change_kind", "field", "old_type", "new_type"))
    want = [(2, "alternative_added", "k", None, "array"), (3, "alternative_added", "o.n", None, "string"), (3, "alternative_removed", "o.n", "integer", None), (3, "path_added", "o.t.new", None, "array")]
    want += [(4, "alternative_removed", "k", "array", None), (4, "path_removed", "o.t.y", "integer", None)]
    assert got == sorted(want, key=repr)


def test_alternatives_follow_a_renamed_field(spark):
    a = [{"id": str(i), "advisor": NAMES[i]} for i in range(8)]
    b = [{"id": str(i + 8), "chair": [NAMES[i]] if i == 3 else NAMES[i]} for i in range(8)]
    got = rows(change_report(lines(spark, {("f", 1): a, ("f", 2): b})).select("change_kind", "field", "old_field", "new_type"))
    assert got == [("alternative_added", "chair", "advisor", "array"), ("renamed", "chair", "advisor", "string")]


def test_two_keys_that_stand_for_one_field_keep_their_values(spark):
    a = [{"id": str(i), "advisor": NAMES[i]} for i in range(8)]
    b = [{"id": str(i + 8), "chair": NAMES[i]} for i in range(8)]
    c = [{"id": str(i + 16), "chair": NAMES[i], "advisor": f"note {i}"} for i in range(8)]
    table, _ = consistent_table(lines(spark, {("f", 1): a, ("f", 2): b, ("f", 3): c}))
    got = {(r["file_no"], r["line_no"]): r for r in table.collect()}
    assert all(got[n, i]["advisor"] == NAMES[i] for n in (1, 2, 3) for i in range(8)) and all(got[3, i]["advisor__again"] == f"note {i}" for i in range(8))
