"""A growing corpus: the vocabulary kept up to date while documents arrive.

The bounded operators of the engine have no streaming counterpart of their own;
this adds running token counts over a file stream of Parquet documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import tokenize


def document_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet documents as they arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``token``, ``count`` over everything seen so far; the state is one number per distinct token."""
    tokens = documents.select(F.explode(tokenize(text)).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("count"))


def windowed_counts(documents: DataFrame, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """``start``, ``token``, ``count`` per time window; state of windows older than ``late`` is dropped."""
    tokens = documents.withWatermark(time, late).select(F.col(time), F.explode(tokenize(text)).alias("token"))
    return tokens.groupBy(F.window(time, window).alias("w"), "token").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "token", "count")
