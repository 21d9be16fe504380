"""Per-key work without stragglers: fragment and replicate by estimated load.

A few keys may hold most rows.  A plain shuffle by key sends each of them to a
single task.  Here the load of every key is counted first, then

* each key above the target load of a task is *heavy* and is cut into shards in
  proportion to its load, each shard with a task of its own choosing;
* all other keys fall into virtual bins by hash, and the bins are packed into
  tasks by load, the heaviest first;
* rows go straight to their task (the partition id is computed, not hashed);
* for a join, the matching side is sent to every task that holds a shard of the
  key, and for all other keys to one task only.

What reaches the driver is bounded: at most ``FINENESS * tasks`` heavy keys and
``BINS_PER_TASK * tasks`` bin totals, whatever the number of rows or keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.session import cut, shuffle_width

#: A key is heavy from 1/FINENESS of a task's fair share on.
FINENESS = 4
BINS_PER_TASK = 16

TASK = "__task"


@dataclass(frozen=True)
class Layout:
    """Where the rows of each key go: heavy keys by table, the rest by bin."""

    spark: SparkSession
    key_type: T.DataType
    tasks: int
    heavy: dict
    bin_tasks: list[int]
    loads: list[int]
    total: int

    def table(self) -> DataFrame:
        """One row per heavy key with the tasks of its shards (bounded by FINENESS * tasks keys)."""
        schema = T.StructType([T.StructField("__key", self.key_type), T.StructField("__shards", T.ArrayType(T.IntegerType()))])
        return self.spark.createDataFrame(list(self.heavy.items()), schema)

    def _bin_task(self, key: Column) -> Column:
        packed = F.split(F.lit(",".join(map(str, self.bin_tasks))), ",").cast("array<int>")  # folded into one literal
        return F.element_at(packed, (_bin(key, len(self.bin_tasks)) + 1).cast("int"))

    def place(self, df: DataFrame, key: str, *within: str) -> DataFrame:
        """``df`` with its rows moved to their tasks; column ``__task`` is the partition id.

        Rows equal in ``key`` and ``within`` meet in one task; the rows of a
        heavy key are spread over its shards by the hash of ``within`` (by all
        columns when none is named).
        """
        spread = [F.col(f"`{c}`") for c in (within or df.columns)]
        shards = F.col("__shards")
        marked = df.join(F.broadcast(self.table()), F.col(f"`{key}`") == F.col("__key"), "left")
        one = F.element_at(shards, (F.pmod(F.xxhash64(*spread), F.size(shards)) + 1).cast("int"))
        task = F.when(shards.isNotNull(), one).otherwise(self._bin_task(F.col(f"`{key}`")))
        return marked.withColumn(TASK, task).drop("__key", "__shards").repartitionById(self.tasks, F.col(TASK))

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """The matching side: one copy of a row for each task that holds rows of its key."""
        marked = df.join(F.broadcast(self.table()), F.col(f"`{key}`") == F.col("__key"), "left")
        goals = F.coalesce(F.array_distinct("__shards"), F.array(self._bin_task(F.col(f"`{key}`"))))
        return marked.withColumn(TASK, F.explode(goals)).drop("__key", "__shards").repartitionById(self.tasks, F.col(TASK))


def _bin(key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bins))


def pack(heavy: dict, bin_loads: list[int], tasks: int, target: float) -> tuple[dict, list[int], list[int]]:
    """Shards of heavy keys and bins to tasks, the largest load first to the least loaded task.

    Returns key -> tasks of its shards, task of each bin, load of each task.
    The shards of one key get different tasks as long as there are enough.
    """
    queue = [(0, t) for t in range(tasks)]
    heapq.heapify(queue)
    shards: dict = {k: [] for k in heavy}
    bin_tasks = [0] * len(bin_loads)
    items: list[tuple[float, int, object]] = [(load, 0, i) for i, load in enumerate(bin_loads)]
    for key, load in heavy.items():
        n = min(tasks, max(1, round(load / target + 0.499)))
        items += [(load / n, 1, key)] * n
    for load, kind, name in sorted(items, key=lambda x: (-x[0], x[1], str(x[2]))):
        used, task = heapq.heappop(queue)
        passed = []
        while kind and task in shards[name] and queue:
            passed.append((used, task))
            used, task = heapq.heappop(queue)
        for entry in passed:
            heapq.heappush(queue, entry)
        heapq.heappush(queue, (used + load, task))
        if kind:
            shards[name].append(task)
        else:
            bin_tasks[name] = task
    loads = [0] * tasks
    for used, task in queue:
        loads[task] = int(used)
    return shards, bin_tasks, loads


def plan_load(counts: DataFrame, key: str, load: str, tasks: int | None = None, summed: bool = False) -> Layout:
    """Layout from the load of each key (``counts``: one row per key, or partial rows of it).

    The counts are exact, over all rows, and worked out once: they are stored
    unless ``summed`` says that they are, with one row per key.  An empty table
    gives a layout of empty bins; a null key is light and has a bin like any other.
    """
    spark = counts.sparkSession
    tasks = tasks or shuffle_width(spark)
    bins = BINS_PER_TASK * tasks
    k = F.col(f"`{key}`")
    per_key = counts.select(k.alias("__key"), F.col(f"`{load}`").alias("__n"))
    if not summed:
        per_key = cut(per_key.groupBy("__key").agg(F.sum("__n").alias("__n")))
    total = per_key.agg(F.sum("__n")).first()[0] or 0
    least = max(1.0, total / tasks / FINENESS)
    heavy = (F.col("__n") > least) & F.col("__key").isNotNull()
    rows = (
        per_key.groupBy(F.when(heavy, F.col("__key")).alias("__heavy"), F.when(~heavy | heavy.isNull(), _bin(F.col("__key"), bins)).alias("__bin"))
        .agg(F.sum("__n").alias("__n"))
        .collect()
    )  # at most FINENESS * tasks heavy keys and `bins` bins
    bin_loads = [0] * bins
    loads = {}
    for r in rows:
        if r["__bin"] is None:
            loads[r["__heavy"]] = r["__n"]
        else:
            bin_loads[r["__bin"]] = r["__n"]
    target = max(1.0, total / tasks)
    shards, bin_tasks, task_loads = pack(loads, bin_loads, tasks, target / 2)
    return Layout(spark, counts.schema[key].dataType, tasks, shards, bin_tasks, task_loads, int(total))


def balanced_aggregate(df: DataFrame, key: str, within: list[str], partial: list[Column], final: list[Column], layout: Layout) -> DataFrame:
    """Per-key aggregate in two steps over balanced tasks.

    ``partial`` aggregates run per task and key over rows that share a shard
    (rows equal in ``key`` and ``within`` always do); ``final`` ones combine
    the few partial rows of each key, one for each of its shards.
    """
    k = f"`{key}`"
    return layout.place(df, key, *within).groupBy(TASK, k).agg(*partial).groupBy(k).agg(*final)


def balanced_join(left: DataFrame, right: DataFrame, key: str, layout: Layout, how: str = "inner") -> DataFrame:
    """Equi-join on ``key``: left rows are fragmented, right rows replicated to the shards.

    ``how`` is inner, left, left_semi or left_anti.  (A right or full join would
    repeat unmatched replicas and is refused.)  Null keys match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r}: only inner, left, left_semi and left_anti keep replicas apart")
    return layout.place(left, key).join(layout.replicate(right, key), [TASK, key], how).drop(TASK)
