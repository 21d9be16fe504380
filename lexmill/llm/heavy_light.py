"""Problem 3: the most frequent items of a huge column with a heavy-light sketch.

Each partition folds its rows into a sketch of fixed size: ``buckets`` exact
buckets that hold one item each, with votes for and against it, and an array of
``counters`` plain counters.  An item that meets its bucket taken by another
votes against the holder; when the votes against reach ``LAMBDA`` times those
for it, the holder is evicted and its count falls into its counter.  Whatever
isn't in a bucket is in a counter.  Sketches of partitions merge bucket by
bucket: the item with the most votes stays, the others fall into counters.

For every item, count <= bucket + counter.  So the sketch bounds what it
doesn't hold, and a second look at the table makes the result exact: the k items
of most votes are recounted, the least of their totals gives a threshold, and
any item, held or not, whose bound reaches it is recounted too.  No item is missed; memory
is that of the sketch, whatever the number of rows or distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

LAMBDA = 8
BUCKETS = 4096
COUNTERS = 1 << 16

_SCHEMA = "part string, slot long, item string, votes long, against long"


class Sketch:
    """Heavy buckets and light counters of one partition; batches are folded in whole."""

    def __init__(self, buckets: int, counters: int) -> None:
        self.item = np.full(buckets, None, dtype=object)
        self.votes = np.zeros(buckets, dtype=np.int64)
        self.against = np.zeros(buckets, dtype=np.int64)
        self.light = np.zeros(counters, dtype=np.int64)

    def fold(self, items: np.ndarray, bucket: np.ndarray, counter: np.ndarray, weight: np.ndarray) -> None:
        """Distinct ``items`` with their slots and weights.

        Per bucket the holder first takes its own votes, all others vote against
        it; then the heaviest of them may take its place.
        """
        order = np.lexsort((-weight, bucket))
        items, bucket, counter, weight = items[order], bucket[order], counter[order], weight[order]
        own = self.item[bucket] == items
        np.add.at(self.votes, bucket[own], weight[own])
        items, bucket, counter, weight = items[~own], bucket[~own], counter[~own], weight[~own]
        if not len(items):
            return
        np.add.at(self.against, bucket, weight)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        at = bucket[first]
        moves = (self.votes[at] == 0) | (self.against[at] >= LAMBDA * self.votes[at])
        at, winner = at[moves], first[moves]
        evicted = self.votes[at] > 0
        self._sink(self.item[at[evicted]], self.votes[at[evicted]])
        self.item[at], self.votes[at], self.against[at] = items[winner], weight[winner], 0
        rest = np.ones(len(items), dtype=bool)
        rest[winner] = False
        np.add.at(self.light, counter[rest], weight[rest])

    def _sink(self, items: np.ndarray, weight: np.ndarray) -> None:
        self.pending = getattr(self, "pending", [])
        self.pending += list(zip(items.tolist(), weight.tolist()))


def _fold_partition(batches: Iterator[pa.RecordBatch], buckets: int, counters: int) -> Iterator[pa.RecordBatch]:
    sketch = Sketch(buckets, counters)
    slots: dict[str, int] = {}  # counter of each item now in a bucket, to sink it there when evicted
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).group_by("item").aggregate([("weight", "sum"), ("bucket", "min"), ("counter", "min")])
        items = np.array(t["item"].to_pylist(), dtype=object)
        counter = t["counter_min"].to_numpy()
        sketch.pending = []
        known = dict(zip(items.tolist(), counter.tolist()))
        sketch.fold(items, t["bucket_min"].to_numpy(), counter, t["weight_sum"].to_numpy())
        for item, weight in sketch.pending:
            sketch.light[slots[item]] += weight
        slots = {i: known[i] if i in known else slots[i] for i in sketch.item.tolist() if i is not None}
    held = np.flatnonzero(sketch.votes)
    lit = np.flatnonzero(sketch.light)
    n, m = len(held), len(lit)
    if n + m:
        yield pa.record_batch(
            [
                pa.array(["heavy"] * n + ["light"] * m),
                pa.array(np.r_[held, lit].astype(np.int64)),
                pa.array(sketch.item[held].tolist() + [None] * m, pa.string()),
                pa.array(np.r_[sketch.votes[held], sketch.light[lit]]),
                pa.array(np.r_[sketch.against[held], np.zeros(m, dtype=np.int64)]),
            ],
            names=["part", "slot", "item", "votes", "against"],
        )


def _slot(item: str, seed: int, size: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(item)), F.lit(size))


def sketch(rows: DataFrame, buckets: int = BUCKETS, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """Merged heavy buckets (slot, item, votes) and light counters (slot, votes) of ``rows`` (item, weight).

    Both are bounded by ``buckets`` and ``counters`` rows.  Null items and
    weights below 1 must have been left out.
    """
    placed = rows.select("item", F.col("weight").cast("long").alias("weight"), _slot("item", 1, buckets).alias("bucket"), _slot("item", 2, counters).alias("counter"))
    parts = cut(placed.mapInArrow(lambda it: _fold_partition(it, buckets, counters), _SCHEMA))  # one sketch per partition, read several times
    by_item = parts.groupBy("part", "slot", "item").agg(F.sum("votes").alias("votes"))
    heavy_all = by_item.filter("part = 'heavy'")
    winner = heavy_all.groupBy("slot").agg(F.max(F.struct("votes", "item")).alias("w")).select("slot", F.col("w.item").alias("item"), F.col("w.votes").alias("votes"))
    lost = heavy_all.join(winner.select("slot", F.col("item").alias("kept")), "slot").filter(F.col("item") != F.col("kept"))
    light = (
        by_item.filter("part = 'light'").select("slot", "votes").unionByName(lost.select(_slot("item", 2, counters).alias("slot"), "votes")).groupBy("slot").agg(F.sum("votes").alias("votes"))
    )
    return winner, light


def top_items(df: DataFrame, item: str, weight: str, k: int, unique: bool = True, buckets: int = BUCKETS, counters: int = COUNTERS) -> DataFrame:
    """The ``k`` items of greatest total weight, of equals the smaller item first: ``item``, ``total``, ``estimate``.

    ``item`` and ``weight`` name columns of ``df``; with ``unique`` rows equal
    in all columns of ``df``, whatever their names, count once.  Repeated rows only raise the sketch's
    upper bounds, so the first pass needs no shuffle to find them.  Null items
    and weights that are null or below 1 don't count; fewer than ``k`` items
    give fewer rows.  ``estimate`` is the sketch's own count.
    """
    spark = df.sparkSession
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if unique and c not in (item, weight)]
    rows = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{weight}`").alias("weight"), *others)
    rows = rows.filter(F.col("item").isNotNull() & (F.col("weight") >= 1))
    heavy, light = sketch(rows, buckets, counters)
    held = heavy.select("item", "votes", _slot("item", 2, counters).alias("slot")).collect()  # at most `buckets` items
    floor = {r["slot"]: r["votes"] for r in light.collect()}  # at most `counters` numbers

    def exact(part: DataFrame) -> DataFrame:
        part = part.distinct() if unique else part
        return part.groupBy("item").agg(F.sum("weight").alias("total"))

    def recount(items: list[str]) -> list[tuple[str, int]]:
        """True totals of a few items."""
        if not items:
            return []
        some = spark.createDataFrame([(x,) for x in items], "item string")
        return [tuple(r) for r in exact(rows.join(F.broadcast(some), "item", "left_semi")).select("item", "total").collect()]

    held_df = spark.createDataFrame([(r["item"], r["votes"]) for r in held], "item string, estimate long")
    by_votes = sorted(held, key=lambda r: (-r["votes"], r["item"]))
    found = recount([r["item"] for r in by_votes[:k]])
    # no more than k items; the least of their totals is a lower bound of the k-th, and only what can reach it is recounted
    threshold = min((n for _, n in found), default=1) if len(found) == k else 1
    found += recount([r["item"] for r in by_votes[k:] if r["votes"] + floor.get(r["slot"], 0) >= threshold])
    tops = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
    threshold = tops[-1][1] if len(tops) == k else 1
    hot = [slot for slot, votes in floor.items() if votes >= threshold]  # the only slots of an unheld item that could count
    top_df = spark.createDataFrame(tops, "item string, total long")
    if hot:
        hot_df = spark.createDataFrame([(h,) for h in hot], "slot long")
        unheld = rows.join(F.broadcast(held_df.select("item")), "item", "left_anti").withColumn("__slot", _slot("item", 2, counters))
        unheld = unheld.join(F.broadcast(hot_df), F.col("__slot") == F.col("slot"), "left_semi").drop("__slot")
        top_df = top_df.unionByName(exact(unheld))
    ranked = top_df.orderBy(F.desc("total"), "item").limit(k)
    return ranked.join(F.broadcast(held_df), "item", "left")
