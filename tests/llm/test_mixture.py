"""Problem 9: budgets by hand, selection by its definition."""

import pytest

from lexmill.llm import mixture
from tests.conftest import rows

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, lang string, text string"


def test_shortages_go_to_siblings_first():
    leaves = [(("a", "x"), 0.4, 100.0), (("a", "y"), 0.1, 1000.0), (("b", "z"), 0.5, 1000.0)]
    got = mixture.budget_leaves(leaves, 1000.0)
    assert got == pytest.approx({("a", "x"): 100.0, ("a", "y"): 400.0, ("b", "z"): 500.0})


def test_what_siblings_cannot_take_goes_up():
    got = mixture.budget_leaves([(("a", "x"), 0.5, 100.0), (("a", "y"), 0.1, 50.0), (("b", "z"), 0.4, 1000.0)], 1000.0)
    assert got == pytest.approx({("a", "x"): 100.0, ("a", "y"): 50.0, ("b", "z"): 850.0})


def test_total_beyond_all_capacity():
    got = mixture.budget_leaves([(("a", "x"), 0.5, 10.0), (("b", "z"), 0.5, 20.0), (("c", "n"), 0.0, 99.0)], 1000.0)
    assert got == pytest.approx({("a", "x"): 10.0, ("b", "z"): 20.0, ("c", "n"): 0.0})


def test_mix(spark):
    docs = [(i, "Main " if i % 3 else "main", "en" if i % 2 else None, "word " * (5 + i % 7)) for i in range(300)]
    docs += [(1000 + i, "small_one", "en", "a b c d") for i in range(5)] + [(2000, None, "en", "x"), (2001, "other", "en", "y"), (2002, "main", "en", ""), (2003, "main", "en", None)]
    targets = [("main", 0.5, 1), ("small_one", 0.3, 3), ("small_two", 0.1, 2), ("missing", 0.1, 5), (None, 0.2, 1)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    used, report = mixture.mix(d, t, total_tokens=1000)
    got = {r["doc_id"]: r for r in used.collect()}
    assert len(got) == used.count()
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"main", "small_one", "small_two", "missing"}
    assert all(r["times"] <= by[r["source"]]["max_repeats"] for r in got.values())
    assert not {2000, 2001, 2002, 2003} & set(got)
    assert [got[1000 + i]["times"] for i in range(5)] == [3] * 5  # short: used as often as allowed
    assert by["missing"]["used_tokens"] == 0 and by["small_one"]["used_tokens"] == by["small_one"]["available_tokens"] * 3
    assert abs(by["main"]["used_tokens"] - by["main"]["budget_tokens"]) <= 20
    assert sum(r["actual_share"] for r in by.values()) == pytest.approx(1.0)
    again, _ = mixture.mix(d.repartition(7), t, total_tokens=1000)
    assert rows(again) == rows(used)
    assert rows(mixture.mix(d, t, total_tokens=1000, seed=2)[0]) != rows(used)
    assert all(rows(mixture.mix(d, t, total_tokens=1000, buckets=n)[0]) == rows(used) for n in (1, 7, 5000))


def test_empty_tables(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    used, report = mixture.mix(d, t)
    assert rows(used) == [] and rows(report.select("source", "used_tokens", "actual_share")) == [("a", 0, 0.0)]
    docs = spark.createDataFrame([(1, "a", "en", "x")], DOCS)
    assert rows(mixture.mix(docs, t.limit(0))[0]) == []
