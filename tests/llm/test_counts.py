"""Problems 1, 3 and 6 against brute force on small tables."""

import random
from collections import Counter, defaultdict
from math import log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import heavy_light, suffix_counts, term_weight
from tests.conftest import rows

SCHEMA = "`nc:id` long, chunk long, token string, count long, loaded_at timestamp_ntz"


def unigrams(seed=3, n=600):
    rnd = random.Random(seed)
    tokens = ["the"] * 8 + ["", "é", "é", "The", "a b", "x" * 3000] + [f"w{i}" for i in range(30)]
    data = [(rnd.randrange(12), rnd.randrange(3), rnd.choice(tokens), rnd.choice([1, 1, 2, 3, 0, None]), None) for _ in range(n)]
    data += [(1, 1, None, 4, None), (None, 1, "the", 4, None), (40, 0, None, None, None)]
    return data + data[: n // 4]


def joint(data):
    out = Counter()
    for r, _, t, n, *_ in set(data):
        if r is not None and t is not None and n is not None and n >= 1:
            out[r, t] += n
    return out


def clashing(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumns({"gram": F.lit(1), "item": F.lit("z"), "records": F.lit(None).cast("string"), "__gram": F.lit(2), "c0": F.lit(3)})


def test_term_frequencies(spark):
    data = unigrams()
    per = defaultdict(Counter)
    for (r, t), n in joint(data).items():
        per[t][r] += n
    records = len({r for r, _ in joint(data)})
    want = []
    for t, c in per.items():
        mark = "rare" if len(c) < 3 else "common" if len(c) > records * 0.2 else None
        want.append((t, sum(c.values()), len(c), mark))
    assert rows(suffix_counts.term_frequencies(clashing(spark, data))) == sorted(want, key=repr)


def test_intervals_over_many_partitions(spark):
    data = [(i, 0, "hot", 1, None) for i in range(2000)] + [(i, 0, f"t{i % 3}", 1, None) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    got = suffix_counts.interval_counts(df, F.col("token"), F.col("`nc:id`"), F.col("count"), tasks=7)
    assert rows(got) == [("hot", 2000, 2000), ("t0", 100, 100), ("t1", 100, 100), ("t2", 100, 100)]


def test_ngrams_with_nulls_ties_and_repeats(spark):
    data = [(1, ["a", "b", "a", "b"]), (1, ["a", "b", "a", "b"]), (1, ["b", "a"]), (2, ["a", None, "b"]), (3, None), (4, []), (None, ["a", "b"]), (5, ["", ""])]
    df = spark.createDataFrame(data, "r long, t array<string>").withColumn("gram", F.lit(1))
    assert rows(suffix_counts.ngram_counts(df, "r", "t", 2)) == sorted([(("a", "b"), 2, 1), (("b", "a"), 2, 1), (("", ""), 1, 1)], key=repr)


def brute_ngrams(data, depth):
    count, held = Counter(), defaultdict(set)
    for r, t in {(r, tuple(t)) for r, t in data if r is not None and t is not None}:
        for i in range(len(t)):
            for n in range(1, depth + 1):
                g = t[i : i + n]
                if len(g) == n and None not in g:
                    count[g] += 1
                    held[g].add(r)
    return sorted(((g, len(g), count[g], len(held[g])) for g in count), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("kept", [2, 100_000])
def test_one_suffix_array_gives_all_lengths(spark, depth, kept, monkeypatch):
    rnd = random.Random(depth)
    data = [(rnd.randrange(9), [rnd.choice(["a", "a", "a", "b", "", "é", None]) for _ in range(rnd.randrange(40))]) for _ in range(60)]
    data += data[:10] + [(1, None), (None, ["a"]), (2, [])]
    df = spark.createDataFrame(data, "r long, t array<string>").withColumns({"n": F.lit(1), "w0": F.lit("z"), "count": F.lit(2)})
    if kept == 2:  # intervals of more records than are kept are written by record (in the workers the constant is as it is)
        batches = [pa.record_batch([pa.array(["a"] * 9), pa.array(list("bbbcccddd")), pa.array([3, 1, 2, 3, 1, 2, 1, 1, 5]), pa.array([1] * 9)], names=["w0", "w1", "__record", "__weight"])]
        schema = pa.schema([("w0", pa.string()), ("w1", pa.string()), ("n", pa.int32()), ("record", pa.int64()), ("count", pa.int64()), ("records", pa.int64()), ("open", pa.bool_())])
        monkeypatch.setattr(suffix_counts, "KEPT_RECORDS", kept)
        out = [r for b in suffix_counts._intervals(iter([b.slice(i, 3) for b in batches for i in (0, 3, 6)]), [1], 2, False, schema) for r in b.to_pylist()]
        assert sum(r["count"] for r in out) == 9 and {r["record"] for r in out} - {None} == {1, 2, 3, 5} and all(r["open"] for r in out)
    assert rows(suffix_counts.all_ngram_counts(df, "r", "t", depth)) == brute_ngrams([(r, t) for r, t in data], depth)


def test_one_record_that_holds_most_rows_is_spread(spark):
    data = [(7, i, "hot", 1, None) for i in range(3000)] * 2 + [(i, 0, "hot", 2, None) for i in range(20)] + [(7, i, "other", 1, None) for i in range(50)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = suffix_counts.interval_counts(df, F.col("token"), F.col("`nc:id`"), F.col("count"), tasks=6)
    assert rows(got) == [("hot", 3040, 20), ("other", 50, 1)]


def test_top_items_are_exact_with_a_tiny_sketch(spark):
    data = unigrams(5, 900)
    totals = Counter()
    for r, _, t, n, *_ in set(data):
        if t is not None and n is not None and n >= 1:
            totals[t] += n
    want = sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:10]
    for buckets, counters in ((2, 3), (64, 256)):
        got = heavy_light.top_items(clashing(spark, data), "token", "count", 10, buckets=buckets, counters=counters)
        assert sorted(((r["item"], r["total"]) for r in got.collect()), key=lambda x: (-x[1], x[0])) == want


def test_sketch_bounds_every_item(spark):
    data = [(f"i{i % 97}", 1 + i % 5) for i in range(5000)] + [("hot", 1)] * 3000
    df = spark.createDataFrame(data, "item string, weight long").repartition(5)
    heavy, light = heavy_light.sketch(df, 8, 16)
    held = {r["item"]: r["votes"] for r in heavy.collect()}
    low = {r["slot"]: r["votes"] for r in light.collect()}
    slots = {r["item"]: r["s"] for r in df.select("item", F.pmod(F.xxhash64(F.lit(2), F.col("item")), F.lit(16)).alias("s")).distinct().collect()}
    true = Counter()
    for k, n in data:
        true[k] += n
    assert all(true[k] <= held.get(k, 0) + low.get(slots[k], 0) for k in true) and held["hot"] > 2500
    assert sum(held.values()) + sum(low.values()) == sum(true.values())


def test_fewer_items_than_asked_for(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("b", 4), (None, 9), ("c", None)], "token string, count long")
    got = heavy_light.top_items(df, "token", "count", 40)
    assert rows(got.select("item", "total")) == [("a", 2), ("b", 4)]


def test_scores(spark):
    data = unigrams(7)
    j = joint(data)
    by_record, by_token, records = Counter(), Counter(), Counter()
    for (r, t), n in j.items():
        by_record[r] += n
        by_token[t] += n
        records[t] += 1
    z = sum(n**0.75 for n in by_record.values())
    want = {(r, t): max(0.0, log(n / by_token[t] * z / by_record[r] ** 0.75)) for (r, t), n in j.items()}
    got = {(r["nc_id"], r["token"]): r for r in term_weight.distinctive_terms(clashing(spark, data)).collect()}
    assert set(got) == set(want) and all(abs(got[k]["score"] - want[k]) < 1e-9 for k in want)
    keep = {(r, t) for (r, t), n in j.items() if n >= 3 and n * 5 >= by_record[r] and 2 <= records[t] <= len(by_record) / 5}
    found = term_weight.characteristic_terms(clashing(spark, data), 3, 1 / 5)
    assert {(r["nc_id"], r["token"]) for r in found.collect()} == keep


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(suffix_counts.term_frequencies(df)) == []
    assert rows(heavy_light.top_items(df, "token", "count", 5)) == []
    assert rows(term_weight.characteristic_terms(df)) == []
    assert rows(suffix_counts.ngram_counts(spark.createDataFrame([], "r long, t array<string>"), "r", "t", 2)) == []
