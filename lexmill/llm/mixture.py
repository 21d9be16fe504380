"""Problem 9: sources mixed to target weights by hierarchical budgeting.

1. Sizes: every document's number of tokens of a public tokenizer.
2. Budget: the weights of the leaves go up a tree (domain, source, language) and
   the total goes down it.  A node whose documents, each used as often as
   allowed, can't fill its budget is short; what it lacks goes to its siblings
   by weight as far as they have room, and only what they can't take goes to
   the next level up.
3. Selection: each leaf has its documents in a seeded order per epoch.  Whole
   epochs use every document once; of the last epoch a prefix is taken, as near
   to the budget as whole documents allow.

Only the leaves (targets x languages) and their seeded buckets' totals are ever
on the driver.  A source that holds a third of all rows is cut by seeded bucket:
only the one bucket in which the prefix ends is put in order, per leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from lexmill.session import cut

#: Buckets of a leaf's order: so many, or more where a bucket would hold more documents than a task should sort.
BUCKETS, BUCKET_DOCUMENTS = 256, 100_000


@dataclass
class Node:
    """A node of the budget tree; leaves carry a weight and a capacity in tokens."""

    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)

    def gather(self) -> None:
        """Weights and capacities of the leaves summed up the tree."""
        if self.children:
            for child in self.children.values():
                child.gather()
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())

    def share_out(self, budget: float) -> None:
        """``budget`` (or what fits) to this node and down, shortages to siblings by weight."""
        self.budget = min(budget, self.capacity)
        given = dict.fromkeys(self.children, 0.0)
        left, open_ = self.budget, [k for k, c in self.children.items() if c.weight > 0 and c.capacity > 0]
        while open_ and left > 1e-9 * max(1.0, self.budget):
            weight = sum(self.children[k].weight for k in open_)
            full = [k for k in open_ if self.children[k].capacity - given[k] <= left * self.children[k].weight / weight]
            for k in full or open_:
                given[k] += min(left * self.children[k].weight / weight, self.children[k].capacity - given[k])
            left = self.budget - sum(given.values())
            if not full:
                break
            open_ = [k for k in open_ if k not in full]
        for k, child in self.children.items():
            child.share_out(given[k])


def budget_leaves(leaves: list[tuple[tuple[str, ...], float, float]], total: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf (path, weight, capacity) of a total."""
    root = Node()
    at: dict[tuple[str, ...], Node] = {}
    for path, weight, capacity in leaves:
        node = root
        for name in path:
            node = node.children.setdefault(name, Node())
        node.weight, node.capacity = weight, capacity
        at[path] = node
    root.gather()
    root.share_out(total)
    return {path: node.budget for path, node in at.items()}


def source_name(column: str):
    """One spelling of a source: without outer white space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.col(f"`{column}`"), r"^\s+|\s+$", "")))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, path: str = DEFAULT_VOCABULARY, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    The mixture has ``doc_id``, ``source``, ``tokens`` and ``times`` (how often
    the document is used, at least 1 and at most ``max_repeats``).  The report
    has a row per target: ``source``, ``target_share``, ``max_repeats``,
    ``available_tokens``, ``budget_tokens``, ``used_tokens``, ``actual_share``.

    ``total_tokens`` is the size asked for (by default the size of all documents
    of targeted sources, once each).  Documents of no or an untargeted source
    and documents without tokens aren't used.  A target without documents
    reports 0.  The domain of a source is its name up to the first underscore;
    the languages of a source are weighted as they occur.  Repeated target rows
    count once (of differing ones the greatest share).  ``buckets`` changes how the work is cut, not the result.  Ties in the seeded order
    go by ``doc_id``; rows with equal ids and texts are documents of their own.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", source_name("source").alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text").filter("source is not null and source <> ''")
    wanted = [r.asDict() for r in targets.groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null").collect()]  # one row per target
    sized = sized.filter(F.col("source").isin([w["source"] for w in wanted]))
    sized = cut(count_tokens(sized, "text", "tokens", path).filter("tokens > 0"))
    leaves = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("n"), F.count("*").alias("documents")).collect()  # targets x languages
    buckets = buckets or max([BUCKETS, *(-(-r["documents"] // BUCKET_DOCUMENTS) for r in leaves)])
    supply: dict[str, int] = {}
    for r in leaves:
        supply[r["source"]] = supply.get(r["source"], 0) + r["n"]
    total = float(total_tokens if total_tokens is not None else sum(supply.values()))
    of = {w["source"]: w for w in wanted}
    domain = lambda s: s.split("_")[0]
    tree = [((domain(r["source"]), r["source"], r["lang"]), (of[r["source"]]["share"] or 0.0) * r["n"] / supply[r["source"]], float(r["n"] * max(0, of[r["source"]]["repeats"] or 0))) for r in leaves]
    tree += [((domain(s), s, ""), of[s]["share"] or 0.0, 0.0) for s in of if s not in supply]
    given = budget_leaves(tree, total)
    plan = []
    for r in leaves:
        budget = given[domain(r["source"]), r["source"], r["lang"]]
        epochs = int(budget // r["n"] + 1e-9)
        plan.append((r["source"], r["lang"], epochs, float(budget - epochs * r["n"])))
    plan_df = spark.createDataFrame(plan, T.StructType([T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("epochs", T.IntegerType()), T.StructField("rest", T.DoubleType())]))

    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    placed = sized.join(F.broadcast(plan_df), ["source", "lang"]).withColumn("place", order)
    placed = placed.withColumn("bucket", F.floor(F.col("place") / F.lit(float(2**64 // buckets))).cast("int"))
    sums = placed.groupBy("source", "lang", "bucket", "rest").agg(F.sum("tokens").alias("n"))  # at most leaves x buckets rows
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("source", "lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", ahead).filter(F.col("before") + F.col("n") > F.col("rest"))
    ends = ends.groupBy("source", "lang").agg(F.min(F.struct("bucket", "before")).alias("end")).select("source", "lang", F.col("end.bucket").alias("end"), F.col("end.before").alias("before"))  # a row per leaf
    placed = placed.join(F.broadcast(ends), ["source", "lang"], "left")
    whole = placed.filter("end is null or bucket <> end").withColumn("extra", F.when(F.col("end").isNull() | (F.col("bucket") < F.col("end")), 1).otherwise(0))
    within = W.partitionBy("source", "lang").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("tokens").over(within) - F.col("tokens") / 2
    edge = placed.filter("bucket = end").withColumn("extra", F.when(upto <= F.col("rest"), 1).otherwise(0))
    used = whole.unionByName(edge).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("times")).filter("times > 0")

    budgets = {s: 0.0 for s in of}
    for (_, s, _), b in given.items():
        budgets[s] += b
    facts = spark.createDataFrame(
        [(s, float(of[s]["share"] or 0.0), int(of[s]["repeats"] or 0), int(supply.get(s, 0)), round(budgets[s], 3)) for s in of],
        "source string, target_share double, max_repeats int, available_tokens long, budget_tokens double",
    )
    by_source = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"))
    report = facts.join(F.broadcast(by_source), "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    whole_used = F.sum("used_tokens").over(W.partitionBy())
    report = report.withColumn("actual_share", F.when(whole_used > 0, F.col("used_tokens") / whole_used).otherwise(F.lit(0.0)))  # one row per target
    return used, report
