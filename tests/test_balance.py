from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators.balance import TASK, balanced_aggregate, balanced_join, pack, plan_load
from lexmill.operators.heavy_tokens import element_leaders, token_leaders, unigram_leaders
from tests.conftest import rows

UNIGRAMS = "`nc:id` long, chunk long, token string, count long, loaded_at timestamp_ntz"


def test_pack_spreads_shards_and_bins():
    shards, bins, loads = pack({"hot": 1000, "warm": 150}, [10] * 40, 8, 100.0)
    assert len(set(shards["hot"])) == 8 and len(shards["warm"]) == 2
    assert len(bins) == 40 and sum(loads) == 1550
    assert max(loads) <= 2 * min(loads)


def test_pack_of_nothing():
    assert pack({}, [0, 0], 2, 1.0)[0] == {}


def skewed(spark):
    data = [("hot", i, 1) for i in range(900)] + [(f"k{i % 50}", i, 2) for i in range(300)] + [(None, 1, 5)]
    return spark.createDataFrame(data, "k string, r long, v long")


def test_rows_of_a_hot_key_are_spread(spark):
    df = skewed(spark)
    layout = plan_load(df.groupBy("k").agg(F.count("*").alias("n")), "k", "n", tasks=8)
    sizes = [n for _, n in rows(layout.place(df, "k", "r").groupBy(F.spark_partition_id()).count())]
    assert sum(sizes) == df.count() and max(sizes) < 300
    placed = layout.place(df, "k", "r")
    assert placed.filter(F.spark_partition_id() != F.col(TASK)).count() == 0


def test_aggregate_and_join_agree_with_plain_ones(spark):
    df = skewed(spark)
    layout = plan_load(df.groupBy("k").agg(F.count("*").alias("n")), "k", "n", tasks=8)
    ours = balanced_aggregate(df, "k", ["r"], [F.sum("v").alias("s")], [F.sum("s").alias("s")], layout)
    assert rows(ours) == rows(df.groupBy("k").agg(F.sum("v").alias("s")))
    side = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("none", "d"), (None, "e")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(balanced_join(df, side, "k", layout, how)) == rows(df.join(side, "k", how)), how


def test_plan_of_the_join_has_no_further_exchange(spark):
    df = skewed(spark)
    layout = plan_load(df.groupBy("k").agg(F.count("*").alias("n")), "k", "n", tasks=8)
    plan = balanced_join(df, df.select("k").distinct(), "k", layout)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS, [plan_id" not in plan.split("SortMergeJoin")[0]


def test_empty_table(spark):
    df = skewed(spark).limit(0)
    layout = plan_load(df.groupBy("k").agg(F.count("*").alias("n")), "k", "n", tasks=4)
    assert rows(layout.place(df, "k", "r")) == []


def leaders_by_hand(data):
    once, out = set(data), {}
    for t in {d[2] for d in data if d[2] is not None}:
        total = Counter()
        for r, _, token, n, *_ in once:
            if token == t and n is not None and n >= 1:
                total[r] += n
        named = {r: n for r, n in total.items() if r is not None}
        best = min(named, key=lambda r: (-named[r], r)) if named else None
        out[t] = (t, sum(d[2] == t for d in data), len(named), sum(total.values()), best, named.get(best))
    return sorted(out.values(), key=repr)


def test_unigram_leaders_by_hand(spark):
    base = [(i % 7, i, "the", 1 + i % 3, None) for i in range(60)] + [(1, 1, "", 4, None), (2, 1, "", 4, None), (3, 1, None, 9, None), (4, 1, "x", None, None), (5, 1, "x", 0, None), (None, 1, "y", 2, None)]
    data = base + base[:20]
    df = spark.createDataFrame(data, UNIGRAMS).withColumn("record", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("__x", F.lit("a"))
    got, total = unigram_leaders(df, tasks=4)
    assert rows(got) == leaders_by_hand(data)
    assert total == sum(d[2] is not None for d in data)


def test_element_leaders(spark):
    data = [("1", 1, ["a", "", "a", None]), ("1", 1, ["a", "", "a", None]), ("2", 2, ["a", "a"]), ("3", 3, None), ("4", 4, [])]
    df = spark.createDataFrame(data, "`@id` string, `nc:id` long, tokenization array<string>")
    got, total = element_leaders(df, tasks=2)
    assert rows(got) == [("", 2, 1, 1, 1, 1), ("a", 6, 2, 4, 1, 2)] and total == 8


def test_leaders_of_empty_tables(spark):
    u = spark.createDataFrame([], UNIGRAMS)
    t = spark.createDataFrame([], "`@id` string, `nc:id` long, tokenization array<string>")
    assert rows(token_leaders(u, t)) == [] and rows(token_leaders(u, t, 0.01)) == []
