"""Queries of the general problems (4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.drift import change_report, consistent_table, schema_changes
from lexmill.operators.heavy_tokens import token_leaders
from lexmill.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_leaders(table(spark, sf_dir, "unigrams"), table(spark, sf_dir, "tokenization"), least_share=0.01)
    return found.select("src", "token", "nc_id")


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_leaders(table(spark, sf_dir, "unigrams"), table(spark, sf_dir, "tokenization"))


P4_TOKENS_SQL = """
WITH u AS (
  SELECT token, "nc:id" AS record, count, count(*) AS copies FROM unigrams WHERE token IS NOT NULL GROUP BY token, "nc:id", count, chunk, loaded_at
), up AS (
  SELECT token, record, sum(copies) AS rows, sum(count) FILTER (WHERE count >= 1) AS total FROM u GROUP BY token, record
), t AS (
  SELECT "nc:id" AS record, tokenization, count(*) AS copies FROM tokenization WHERE tokenization IS NOT NULL GROUP BY "@id", "nc:id", tokenization
), te AS (
  SELECT record, copies, unnest(tokenization) AS token FROM t
), tp AS (
  SELECT token, record, sum(copies) AS rows, count(*) AS total FROM te WHERE token IS NOT NULL GROUP BY token, record
), p AS (
  SELECT 'unigrams' AS src, * FROM up UNION ALL SELECT 'tokenization' AS src, * FROM tp
), best AS (
  SELECT src, token, record, total, row_number() OVER (PARTITION BY src, token ORDER BY total DESC, record) AS rn
  FROM p WHERE total IS NOT NULL AND record IS NOT NULL
)
SELECT p.src, p.token, CAST(sum(p.rows) AS BIGINT) AS rows, CAST(count(CASE WHEN p.total IS NOT NULL THEN p.record END) AS BIGINT) AS records,
       CAST(coalesce(sum(p.total), 0) AS BIGINT) AS amount, any_value(b.record) AS nc_id, CAST(any_value(b.total) AS BIGINT) AS nc_id_total
FROM p LEFT JOIN best b ON b.src = p.src AND b.token = p.token AND b.rn = 1
GROUP BY p.src, p.token
"""

P4_FOUND_SQL = f"""
WITH leaders AS ({P4_TOKENS_SQL}), totals AS (SELECT src, sum(rows) AS n FROM leaders GROUP BY src)
SELECT l.src, l.token, l.nc_id FROM leaders l JOIN totals t ON t.src = l.src WHERE l.rows > t.n * 0.01 AND l.nc_id IS NOT NULL
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = schema_changes(table(spark, sf_dir, "dissertation_files"))
    return changes.select("feed", "file_no", "change_kind", "field").distinct()


def p7_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with old names and types, and the changes within fields."""
    return change_report(table(spark, sf_dir, "dissertation_files"))


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole line in one consistent table."""
    return consistent_table(table(spark, sf_dir, "dissertation_files"))[0]


QUERIES = {"p7_found": p7_found, "p7_changes": p7_changes, "p7_table": p7_table, "p4_found": p4_found, "p4_tokens": p4_tokens}
ORACLES = {"p4_found": P4_FOUND_SQL, "p4_tokens": P4_TOKENS_SQL}
