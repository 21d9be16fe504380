"""Problem 6: how distinctive a term is for a record.

Positive pointwise mutual information of term and record, from the joint and
marginal counts, the record marginal smoothed by a fractional exponent:

    score = max(0, ln( n(t,r) / n(t) * Z / n(r)^a )),  Z = sum over records of n(r)^a

Group-bys and joins only.  Rows are spread by (record, token) once; repeats are
left out and counts added up in place, so neither a term nor a record that
holds a third of all rows makes a straggler.  The joins with the marginals are
laid out by load (the number of joint rows of a key), for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.unigram_rows import countable
from lexmill.operators.balance import balanced_join, plan_load
from lexmill.session import cut, shuffle_width


def _joint(unigrams: DataFrame) -> DataFrame:
    """``nc_id``, ``token``, ``count``: the joint counts, stored."""
    rows = countable(unigrams)
    placed = rows.repartition(shuffle_width(rows.sparkSession), "`nc:id`", "token")
    return cut(placed.distinct().groupBy(F.col("`nc:id`").alias("nc_id"), "token").agg(F.sum("count").alias("count")))


def _marginals(joint: DataFrame, exponent: float) -> tuple[DataFrame, DataFrame, int, float]:
    by_record = cut(joint.groupBy("nc_id").agg(F.sum("count").alias("record_total"), F.count("*").alias("terms")))
    by_token = cut(joint.groupBy("token").agg(F.sum("count").alias("token_total"), F.count("*").alias("records")))
    records, z = by_record.agg(F.count("*"), F.sum(F.pow("record_total", F.lit(exponent)))).first()
    return by_record, by_token, records, z or 0.0


def _scored(rows: DataFrame, records: int, z: float, exponent: float) -> DataFrame:
    pmi = F.log(F.col("count") / F.col("token_total") * F.lit(z) / F.pow("record_total", F.lit(exponent)))
    return rows.select("nc_id", "token", "count", "record_total", "records", "token_total", F.lit(records).alias("all_records"), F.greatest(F.lit(0.0), pmi).alias("score"))


def distinctive_terms(unigrams: DataFrame, exponent: float = 0.75) -> DataFrame:
    """``nc_id``, ``token``, ``count`` (in the record), ``record_total``, ``records`` (that hold the token), ``token_total``, ``all_records``, ``score``.

    Rows equal in all columns count once; rows with a null token or record or a
    count that is null or below 1 don't count; the empty string is a token.  An
    empty table gives no rows.
    """
    joint = _joint(unigrams)
    by_record, by_token, records, z = _marginals(joint, exponent)
    rows = balanced_join(joint, by_record.drop("terms"), "nc_id", plan_load(by_record, "nc_id", "terms", summed=True))
    rows = balanced_join(rows, by_token, "token", plan_load(by_token, "token", "records", summed=True))
    return _scored(rows, records, z, exponent)


def characteristic_terms(unigrams: DataFrame, least_count: int = 3, share: float = 1 / 25, exponent: float = 0.75) -> DataFrame:
    """Terms that stand out, with their scores: at least ``least_count`` times and ``share`` of their record, in 2 records or more but at most ``share`` of all.

    Columns and cases as of :func:`distinctive_terms`.  Each condition is applied
    as soon as what it needs is there, so that only terms that make up enough of
    their record meet the tokens' marginals, and only those of few records.
    """
    part = F.lit(round(1 / share))
    joint = _joint(unigrams)
    by_record, by_token, records, z = _marginals(joint, exponent)
    often = joint.filter(F.col("count") >= least_count)
    loads = often.groupBy("nc_id").agg(F.count("*").alias("n"))
    rows = balanced_join(often, by_record.drop("terms"), "nc_id", plan_load(loads, "nc_id", "n"))
    rows = cut(rows.filter(F.col("count") * part >= F.col("record_total")))
    loads = rows.groupBy("token").agg(F.count("*").alias("n"))
    few = by_token.filter((F.col("records") >= 2) & (F.col("records") * part <= F.lit(records)))
    rows = balanced_join(rows, few, "token", plan_load(loads, "token", "n"))
    return _scored(rows, records, z, exponent).filter("score is not null")
