"""Which rows of a word-count table count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def countable(unigrams: DataFrame) -> DataFrame:
    """Rows with a token, a record and a count of at least 1, repeated rows still in.

    The filter reaches the Parquet scan.
    """
    return unigrams.filter(F.col("token").isNotNull() & F.col("`nc:id`").isNotNull() & (F.col("count") >= 1))


def record_count(unigrams: DataFrame) -> int:
    """Number of records among the countable rows."""
    return countable(unigrams).agg(F.countDistinct("`nc:id`")).first()[0]
