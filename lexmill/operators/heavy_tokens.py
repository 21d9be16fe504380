"""Per-token totals and leading record when a few tokens hold most rows.

Both inputs are brought to rows (token, record, weight) and every token gets one
result row.  The work is laid out by :mod:`lexmill.operators.balance`: the load
of a token is its number of rows, large tokens are sharded by record, and each
shard yields one partial row, so no task sees more than about its fair share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.balance import TASK, plan_load
from lexmill.session import shuffle_width


def _per_task(pairs: DataFrame) -> DataFrame:
    """One row per task and token of ``pairs`` (task, token, record, rows, total): sums, and the record with the greatest total, of equals the smallest id.

    Records of equal totals are settled first, so that both steps hash and none sorts.
    """
    known = F.col("record").isNotNull() & F.col("total").isNotNull()
    equal = pairs.groupBy(TASK, "token", F.when(known, F.col("total")).alias("reached")).agg(F.sum("rows").alias("rows"), F.count(F.when(known, 1)).alias("records"), F.sum("total").alias("amount"), F.min(F.when(known, F.col("record"))).alias("record"))
    best = F.max_by("record", "reached")
    return equal.groupBy(TASK, "token").agg(F.sum("rows").alias("rows"), F.sum("records").alias("records"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.max("reached").alias("reached"), best.alias("record"))


def _finish(per_task: DataFrame) -> DataFrame:
    best = F.max(F.when(F.col("record").isNotNull(), F.struct(F.col("reached").alias("total"), (-F.col("record")).alias("minus"))))
    return (
        per_task.groupBy("token")
        .agg(F.sum("rows").alias("rows"), F.sum("records").alias("records"), F.sum("amount").alias("amount"), best.alias("best"))
        .select("token", "rows", "records", "amount", (-F.col("best.minus")).alias("nc_id"), F.col("best.total").alias("nc_id_total"))
    )


def unigram_leaders(unigrams: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """One row per token of ``unigrams``, and the number of rows that have a token.

    ``rows`` counts every row of the token, repeated ones and those without a
    usable count included.  ``amount`` (total of count), ``records`` and
    ``nc_id`` (the record with the greatest total, of equals the smallest) take
    rows equal in all columns once and leave out counts that are null or below
    1; they are 0, 0 and null for a token without any such row.  Rows with a
    null token are left out, the empty string is a token, rows with a null
    record add to ``rows`` and ``amount`` only.  An empty table gives no rows.
    """
    held = unigrams.filter(F.col("token").isNotNull())
    layout = plan_load(held.groupBy("token").agg(F.count("*").alias("n")), "token", "n", tasks)
    columns = [f"`{c}`" for c in held.columns]
    once = layout.place(held, "token", "nc:id").groupBy(TASK, *columns).agg(F.count("*").alias("__copies"))
    valid = F.when(F.col("count") >= 1, F.col("count"))
    pairs = once.groupBy(TASK, "token", F.col("`nc:id`").alias("record")).agg(F.sum("__copies").alias("rows"), F.sum(valid).alias("total"))
    return _finish(_per_task(pairs)), layout.total


def element_leaders(tokenization: DataFrame, tasks: int | None = None) -> tuple[DataFrame, int]:
    """One row per element value of ``tokenization.tokenization``, and the number of elements.

    ``rows`` counts the elements over all rows, repeated rows included;
    ``amount``, ``records`` and ``nc_id`` take repeated rows once.  Null arrays
    and null elements are left out, the empty string is a token.
    """
    held = tokenization.filter(F.col("tokenization").isNotNull())
    columns = [f"`{c}`" for c in held.columns]
    elements = held.select(F.explode("tokenization").alias("token")).filter(F.col("token").isNotNull())
    layout = plan_load(elements.groupBy("token").agg(F.count("*").alias("n")), "token", "n", tasks)
    # equal rows meet by a hash of their content, then elements are counted by row where they are: only counts move to the tokens' tasks
    hashed = held.withColumn("__row", F.xxhash64(*columns))
    once = hashed.repartition(shuffle_width(held.sparkSession), "__row").groupBy("__row", *columns).agg(F.count("*").alias("__copies"))
    numbered = once.select("__row", F.monotonically_increasing_id().alias("__at"), F.col("`nc:id`").alias("record"), "__copies", "tokenization")
    numbered = numbered.select("__row", "__at", "record", "__copies", F.explode("tokenization").alias("token")).filter(F.col("token").isNotNull())
    rows = numbered.groupBy("__row", "__at", "record", "__copies", "token").agg(F.count("*").alias("n"))
    placed = layout.place(rows.select("record", "__copies", "token", "n"), "token", "record")
    pairs = placed.groupBy(TASK, "token", "record").agg(F.sum(F.col("__copies") * F.col("n")).alias("rows"), F.sum("n").alias("total"))
    return _finish(_per_task(pairs)), layout.total


def token_leaders(unigrams: DataFrame, tokenization: DataFrame, least_share: float | None = None) -> DataFrame:
    """Both sources in one table, column ``src`` naming them.

    With ``least_share`` only tokens that hold more than that share of the rows
    with a token, and that have a leading record, are kept.
    """
    parts = []
    for src, (df, total) in (("unigrams", unigram_leaders(unigrams)), ("tokenization", element_leaders(tokenization))):
        df = df.select(F.lit(src).alias("src"), "*")
        if least_share is not None:
            df = df.filter((F.col("rows") > F.lit(total) * F.lit(least_share)) & F.col("nc_id").isNotNull())
        parts.append(df)
    return parts[0].unionByName(parts[1])
