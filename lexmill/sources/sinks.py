"""Where corpora and features are written."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.catalog import stack_of
from lexmill.operators.features import ID
from lexmill.sources import files


def write_stacks(df: DataFrame, path: str, batch_size: int = 65536) -> None:
    """A table by stacks of ``batch_size`` documents: the partition column is ``stack``."""
    df.withColumn("stack", stack_of(batch_size)).repartition("stack").sortWithinPartitions("stack", f"`{ID}`").write.mode("overwrite").option("compression", "zstd").partitionBy("stack").parquet(path)


def read_written(spark: SparkSession, path: str, only_stacks: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A stored table; ``only_stacks`` prunes partitions, ``columns`` prunes columns."""
    df = spark.read.parquet(path)
    if only_stacks is not None:
        df = df.filter(F.col("stack").isin(only_stacks))
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def export(catalog: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """Catalog and document-level features in one table, a feature's columns named ``nc:{column}``; joined by ``nc:id``."""
    out = catalog
    for df in features.values():
        out = out.join(df.select(F.col(f"`{ID}`"), *[F.col(f"`{c}`").alias(f"nc:{c}") for c in df.columns if c != ID]), ID, "left")
    return out


class StackBuilder:
    """Documents added one by one and written as Parquet files of at most ``max_docs_in_file`` documents, in row groups of at most ``max_docs_in_batch``.

    Documents are kept as Arrow batches of ``max_docs_in_batch`` until their file
    is full, so the driver holds one file's documents.
    """

    KEYS = ("text", "tokenization")

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, max_docs_in_file: int = 16384, max_docs_in_batch: int = 128) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.spark, self.path, self.schema = spark, path, schema
        self.max_docs_in_file, self.max_docs_in_batch = max_docs_in_file, min(max_docs_in_batch, max_docs_in_file)
        self.arrow = to_arrow_schema(schema)
        self.rows: list[dict] = []
        self.batches: list[pa.RecordBatch] = []
        self.files = 0

    def add(self, metadata: dict, **content) -> None:
        if unknown := set(content) - set(self.KEYS):
            raise KeyError(f"only {' and '.join(self.KEYS)} can be added, not {', '.join(sorted(unknown))}")
        self.rows.append(metadata | {f"nc:{k}": v for k, v in content.items()})
        held = sum(b.num_rows for b in self.batches) + len(self.rows)
        if len(self.rows) >= self.max_docs_in_batch or held >= self.max_docs_in_file:
            self._batch()
        if held >= self.max_docs_in_file:
            self.flush()

    def _batch(self) -> None:
        if self.rows:
            columns = [pa.array([r.get(f.name) for r in self.rows], f.type) for f in self.arrow]
            self.batches.append(pa.RecordBatch.from_arrays(columns, schema=self.arrow))
            self.rows = []

    def flush(self) -> None:
        """Write what is held as one file; columns of the schema that a document lacks are null."""
        self._batch()
        if not self.batches:
            return
        held = self.spark.createDataFrame(pa.Table.from_batches(self.batches, self.arrow), self.schema)
        writer = held.coalesce(1).write.mode("append").option("compression", "zstd").option("parquet.block.row.count.limit", str(self.max_docs_in_batch))
        writer.parquet(self.path)
        self.batches, self.files = [], self.files + 1

    def __enter__(self) -> StackBuilder:
        return self

    def __exit__(self, *_) -> None:
        self.flush()


def is_complete(path: str) -> bool:
    return files.exists(files.join(path, "_SUCCESS"))


def fingerprint(path: str) -> str:
    """Size and time of change of a source, to tell whether what was made of it is still good."""
    return ";".join(f"{files.name_of(name)}:{size}:{changed}" for name, size, changed in files.files_below(path))
