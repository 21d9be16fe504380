"""Problem 2: the segment join against brute force, and names by example."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import names
from tests.conftest import rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segment_join_misses_nothing(spark, edits):
    rnd = random.Random(edits)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(150)}
    df = spark.createDataFrame([("g", w) for w in words] + [("h", "abab"), ("h", "abba")], "grp string, key string")
    want = {frozenset((a, b)) for a in words for b in words if a < b and min(len(a), len(b)) > edits and distance(a, b) <= edits}
    got = {frozenset((r["a"], r["b"])) for r in names.segment_join(df, edits).filter("grp = 'g'").collect()}
    assert got == want


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_close_keys_finds_short_keys(spark, edits):
    rnd = random.Random(edits)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 8))) for _ in range(120)} | {"", "zoe", "zoee", "leo", "loe"}
    df = spark.createDataFrame([("g", w) for w in words] + [("h", "a")], "grp string, key string")
    want = {((a, b) if (len(a), a) > (len(b), b) else (b, a), distance(a, b)) for a in words for b in words if a < b and distance(a, b) <= edits}
    found = names.close_keys(df, edits).collect()
    assert {((r["a"], r["b"]), r["distance"]) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("join", [names.segment_join, names.close_keys])
def test_segments_are_never_broadcast(spark, join):
    """A few bytes of keys, which Spark would broadcast by its estimate, become many segments."""
    met = join(spark.createDataFrame([("g", "marutani"), ("g", "marutnai"), ("g", "zoe")], "grp string, key string"), 2)
    assert {(r["a"], r["b"]) for r in met.collect()} == {("marutnai", "marutani")}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spellings_lead_to_the_most_frequent(spark):
    df = spark.createDataFrame([("g", "marutani", 9), ("g", "marutnai", 1), ("g", "marutnaii", 1), ("g", "other", 5)], "grp string, key string, n long")
    got = {r["key"]: r["root"] for r in names.settle_spellings(df, 2, F.lit(True)).collect()}
    assert got == {"marutani": "marutani", "marutnai": "marutani", "marutnaii": "marutani", "other": "other"}


def test_the_nearer_spelling_before_the_more_frequent(spark):
    data = [("g", "abcdefgh", 5), ("g", "abcdefgx", 1), ("g", "yycdefgx", 50), ("g", "yycdefgz", 2)]
    got = {r["key"]: r["root"] for r in names.settle_spellings(spark.createDataFrame(data, "grp string, key string, n long"), 2, F.lit(True)).collect()}
    assert got == {"abcdefgh": "abcdefgh", "abcdefgx": "abcdefgh", "yycdefgx": "yycdefgx", "yycdefgz": "yycdefgx"}


SAME = [
    ["Marutani, Edward A.", "Edward A. Marutani", "MARUTANI, Edward A. ", "marutani, ted a.", "Marutani, E. A.", "Marutani E", "Dr. Edward Marutanl", "Marutani, Edward Augustine, 1801-1870", "Marutani, E. (Edward)", " Prof. Edwrad A. Marutani."],
    ["Marutani, Josephine"],
    ["de Rozamökin, Zoë, Jr.", "Zoë de Rozamokin Jr", "DE ROZAMÖKIN, Zoe, Jr."],
    ["de Rozamökin, Zoë, Sr.", "Zoë deRozamökin, Sr"],
    ["Hatozade University of Bridge Records", "The Hatozade Univ. of Bridge Records", "UNIVERSITY OF BRIDGE RECORDS, HATOZADE", "Hatozade University (Bridge Recrods)", "Hatozde University for Bridge Records"],
    ["Hatozade University of Loom and Dye Works", "Hatozade Univ. of Loom & Dye Works"],
    ["Hatozade Institute of Bridge Records"],
]


def test_entities_by_example(spark):
    data = [(n,) for group in SAME for n in group] + [(SAME[0][0],)] * 5 + [(SAME[4][0],)] * 3 + [(None,), ("",), ("Anonymous",), ("Unknown",), ("  ",), ("?",)]
    e = names.name_entities(spark.createDataFrame(data, "name string"))
    of = {r["name"]: r["entity"] for r in e.collect()}
    assert not {"", "Anonymous", "Unknown", "  "} & set(of)
    for group in SAME:
        assert len({of[n] for n in group}) == 1, group
    assert len({of[g[0]] for g in SAME}) == len(SAME)
    pairs = {(r["name_a"], r["name_b"]) for r in names.name_pairs(e).collect()}
    assert pairs == {(a, b) for g in SAME for a in g for b in g if a < b}
    links = {r["name"]: r["links"] for r in names.entity_classes(e).collect()}
    assert links[SAME[0][0]] == 9


def test_initials_that_fit_two_people_stay_apart(spark):
    data = [("Kozazelo, Dorothea",), ("Kozazelo, David",), ("Kozazelo, D.",)]
    of = {r["name"]: r["entity"] for r in names.name_entities(spark.createDataFrame(data, "name string")).collect()}
    assert len(set(of.values())) == 3


def test_odd_names(spark):
    data = [("x",), ("Jr.",), ("123",), (",",), ("a" * 5000,), ("van",), ("Ж. Иванов",), ("()",), ("University",)]
    e = names.name_entities(spark.createDataFrame(data, "name string"))
    assert e.count() <= len(data)
    assert rows(names.name_entities(spark.createDataFrame([], "name string"))) == []


#: People and bodies of their own, however near their names are.
APART = [
    ("Harris, John", "Morris, John"), ("Hanson, Mary", "Jansen, Mary"), ("Parker, Anne", "Barker, Anne"), ("Smith, Eric", "Smith, Erica"), ("Smith, Daniel", "Smith, Danielle"),
    ("Reed, Francis", "Reed, Frances"), ("Hatozade University of Law", "Hatozade University of Art"), ("Hatozade University of Geology", "Hatozade University of Zoology"), ("Milton, Marc", "Hilton, Marc"),
]


@pytest.mark.parametrize("pair", APART)
def test_near_names_of_two_stay_apart(spark, pair):
    of = {r["name"]: r["entity"] for r in names.name_entities(spark.createDataFrame([(n,) for n in pair], "name string")).collect()}
    assert len(set(of.values())) == 2


def test_near_names_stay_apart_where_both_are_well_known(spark):
    first = ["John", "Mary", "Peter", "Susan", "Quentin", "Ruth"]
    data = [f"{s}, {g}" for s in ("Hansen", "Hanson", "Clark", "Clarke") for g in first] + ["Clark, Eric", "Clark, Erica", "Hansen, Eric", "Hansen, Erica", "Hanson, Eric", "Hanson, Erica"]
    data += [f"{p} University of {f}" for p in ("Hatozade", "Kolumira", "Bendevar", "Sopinath") for f in ("Geology", "Zoology", "Law", "Art", "Land Survey", "Survey")]
    of = {r["name"]: r["entity"] for r in names.name_entities(spark.createDataFrame([(n,) for n in data], "name string")).collect()}
    assert len(set(of.values())) == len(data)


def test_slips_in_bodies(spark):
    base = ["Hatozade Institute of Grain and Barley Trade", "Kolumira Institute of Grain and Barley Trade", "Bendevar Society of Brine Studies", "Sopinath Society of Brine Studies", "Bendevar Society of Grain and Barley Trade"]
    slips = ["Hatozade Institute of Grain ande Barley Trade", "Hatozade Institute of Grain and Barley rTade", "Hatozade Inst. for Graain & Barley Trade", "Hatozade Institute (Grain and Barley Trade)"]
    glued = ["Bendevar Society of BrineeStudies", "Bendevar Soc. of Brine tSudies"]
    of = {r["name"]: r["entity"] for r in names.name_entities(spark.createDataFrame([(n,) for n in base + slips + glued], "name string")).collect()}
    assert {of[n] for n in slips} == {of[base[0]]} and {of[n] for n in glued} == {of[base[2]]}
    assert len({of[n] for n in base}) == len(base)


def test_nicknames_are_data_of_the_caller(spark):
    df = spark.createDataFrame([("Okparavo, Chukwuemeka",), ("Okparavo, Emeka",), ("Okparavo, Bob",), ("Okparavo, Robert",)], "name string")
    of = lambda **kw: {r["name"]: r["entity"] for r in names.name_entities(df, **kw).collect()}
    own = of(nicknames={"emeka": "chukwuemeka"})
    assert own["Okparavo, Emeka"] == own["Okparavo, Chukwuemeka"] and own["Okparavo, Bob"] != own["Okparavo, Robert"]
    assert len(set(of(nicknames={}).values())) == 4 and len(set(of().values())) == 3
