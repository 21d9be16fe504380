"""Text sources: each gives ``@id`` and ``text``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.catalog import first_wins, infer_id_field
from lexmill.sources import files as at_files


def _empty_files(spark: SparkSession, path: str, ending: str) -> list[str]:
    """Names of files without content, which Spark's readers pass over."""
    found = [at_files.name_of(name) for name, size, _ in at_files.files_below(path, spark) if not size]
    return [name.removesuffix(ending) for name in found if name.endswith(ending)]


def read_folder(spark: SparkSession, path: str, format: str = "txt", compression: str | None = None) -> DataFrame:
    """One document per file, folders walked in full; the id is the file's name without its ending.

    Compressed files are read by their ending; with ``compression`` only those
    are taken.  Empty files are documents with an empty text.
    """
    ending = f".{format}" + (f".{compression}" if compression else "")
    pattern = f"*.{format}" if compression is None else f"*{ending}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern if compression else f"*.{format}{{,.gz}}").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), re.escape(f".{format}") + r"(?:\.gz)?$", "")
    raw = files.filter(~F.col("path").endswith(".gz")).select(name.alias("@id"), F.decode("content", "UTF-8").alias("text"))
    packed = files.filter(F.col("path").endswith(".gz")).select(name.alias("@id"), "content")

    def unpack(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            texts = [gzip.decompress(x).decode("utf-8", "replace") for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["@id", "text"])

    empty = spark.createDataFrame([(n, "") for n in _empty_files(spark, path, ending)], "`@id` string, text string")
    return raw.unionByName(packed.mapInArrow(unpack, "`@id` string, text string")).unionByName(empty)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line, ``id<TAB>text`` cut at the first tab; lines without one are dropped, of equal ids the first line stays."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at")).filter(F.instr("value", "\t") > 0)
    cut = F.instr("value", "\t")
    rows = lines.select(F.substring_index("value", "\t", 1).alias("@id"), F.substring("value", cut + 1, F.length("value")).alias("text"), "__file", "__at")
    return first_wins(rows, "@id", ["__file", "__at"]).select("`@id`", "text")


def read_field(catalog: DataFrame, field: str, id: str | None = None) -> DataFrame:
    """Texts held in a column of a catalog."""
    id = id or infer_id_field(catalog)
    return catalog.select(F.col(f"`{id}`").cast("string").alias("@id"), F.col(f"`{field}`").alias("text"))


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet stacks, found in all folders below ``path``."""
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)


def stack_texts(stacks: DataFrame) -> DataFrame:
    """Only id and ``nc:text`` are read."""
    return stacks.select(F.col("`@id`").cast("string").alias("@id"), F.col("`nc:text`").alias("text"))


def stack_metadata(stacks: DataFrame) -> DataFrame:
    """Columns that aren't features (``nc:``); the numeric id stays."""
    return stacks.select(*[f"`{c}`" for c in stacks.columns if not c.startswith("nc:") or c == "nc:id"])


def read_texts(spark: SparkSession, path: str, format: str = "txt", compression: str | None = None) -> DataFrame:
    """A folder, one file of lines, or Parquet stacks, whichever ``path`` is."""
    if format == "parquet":
        return stack_texts(read_stacks(spark, path))
    if at_files.is_folder(path, spark):
        return read_folder(spark, path, format, compression)
    return read_lines(spark, path)


def ids_by_file(stacks: DataFrame, id: str = "@id") -> DataFrame:
    """``@id`` and the ``file`` that holds it."""
    return stacks.select(F.col(f"`{id}`").cast("string").alias("@id"), F.col("_metadata.file_path").alias("file"))
