"""Catalog sources: NDJSON, CSV, TSV, Feather and Parquet, by the ending of the path."""

from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.catalog import wrap_arrays
from lexmill.sources import files


def read_ndjson(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Lines of JSON, also compressed.  A field that is an array in some lines and a single value in others becomes an array throughout.

    Numbers mixed with other strings give a string column; with ``strict`` that
    is a ``ValueError``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.try_parse_json("value").alias("v"), "value")
    keys = lines.filter(F.col("v").isNotNull()).select(F.explode(F.expr("cast(v as map<string,variant>)")).alias("key", "v"))
    kind = F.schema_of_variant("v")
    plain = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    types: dict[str, set] = {}
    for r in keys.select("key", plain.alias("t")).distinct().collect():  # fields x types
        types.setdefault(r["key"], set()).add(r["t"])
    mixed = [k for k, t in types.items() if "array" in t and t - {"array", "null"}]
    loose = [k for k, t in types.items() if {"number", "string"} <= t]
    if strict and loose:
        raise ValueError(f"numbers and strings are mixed in {', '.join(sorted(loose))}")
    df = spark.read.json(path)
    return wrap_arrays(df, mixed) if mixed else df


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, multiLine=True, escape='"')


ENDINGS = ("ndjson", "json", "jsonl", "csv", "tsv", "feather", "arrow", "parquet")
#: Signed types that hold what unsigned ones may; fixed values.
SIGNED = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "uint64": "decimal128(20, 0)"}


def _spark_ready(t):
    """An Arrow table in types that Spark has: unsigned numbers in the next signed type, dictionaries as their values, times and nulls as strings."""
    import pyarrow as pa

    for i, f in enumerate(t.schema):
        column = t.column(i)
        if pa.types.is_dictionary(f.type):
            column = column.cast(f.type.value_type)
        elif str(f.type) in SIGNED:
            column = column.cast(pa.decimal128(20, 0) if f.type == pa.uint64() else pa.type_for_alias(SIGNED[str(f.type)]))
        elif pa.types.is_time(f.type) or pa.types.is_null(f.type):
            column = column.cast(pa.string())
        t = t.set_column(i, f.name, column)
    return t


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files, a task each: one file or all of a folder, on any file system; unsigned numbers get the next signed type, dictionaries their values.

    The columns are those of the first file by path; a file that lacks one has nulls.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def table(content: bytes):
        import pyarrow as pa
        from pyarrow import feather

        return _spark_ready(feather.read_table(pa.BufferReader(content)))

    def schema_of(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        for b in batches:
            shown = [from_arrow_schema(table(x).slice(0, 0).schema).json() for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string())], names=["schema"])

    first = content.orderBy("path").limit(1).select("content").mapInArrow(schema_of, "schema string").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(json.loads(first["schema"]))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for b in batches:
            for x in b.column("content").to_pylist():
                t = table(x)
                columns = {f.name: t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in wanted}
                yield from pa.table(columns, schema=wanted).to_batches()

    return content.select("content").mapInArrow(run, schema)


def read_catalog(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A catalog by its ending (``.gz`` aside); a folder without one that is known holds Parquet stacks."""
    name = files.name_of(path).removesuffix(".gz")
    kind = format or ("ndjson" if name == "jsoncatalog.txt" else name.rpartition(".")[2])
    if kind not in ENDINGS and files.is_folder(path, spark):
        kind = "parquet"
    if kind in ("ndjson", "json", "jsonl"):
        return read_ndjson(spark, path)
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if kind == "tsv" else ",")
    if kind in ("feather", "arrow"):
        return read_feather(spark, path)
    if kind == "parquet":
        return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "false").parquet(path)
    raise NotImplementedError(f"no reader for {path}")


def survey_parquet(paths: list[str]) -> dict[str, Counter]:
    """Types of each column over Parquet files, with the number of files of each: from the footers only."""
    import pyarrow.parquet as pq

    seen: dict[str, Counter] = {}
    for p in paths:
        for f in pq.read_schema(p):
            seen.setdefault(f.name, Counter())[str(f.type)] += 1
    return seen


def read_messy_parquet(spark: SparkSession, paths: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Parquet files whose columns differ in type: each is cast to the type most files have, or to the one named in ``types``."""
    schemas = {p: spark.read.parquet(p).schema for p in paths}
    votes: dict[str, Counter] = {}
    for s in schemas.values():
        for f in s:
            votes.setdefault(f.name, Counter())[f.dataType.simpleString()] += 1
    chosen = {c: (types or {}).get(c) or min(v, key=lambda t: (-v[t], t)) for c, v in votes.items()}
    groups: dict[str, list[str]] = {}
    for p, s in schemas.items():
        groups.setdefault(s.json(), []).append(p)
    out = None
    for same in groups.values():  # one scan per distinct schema, not per file
        df = spark.read.parquet(*same)
        df = df.select(*[F.col(f"`{c}`").try_cast(chosen[c]).alias(c) if isinstance(df.schema[c].dataType, T.AtomicType) else F.col(f"`{c}`") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def load_settings(folder: str, name: str = ".lexmill.yaml") -> dict:
    """The settings file of a folder or of the nearest folder above it, as a dict; empty without one."""
    at = Path(folder).resolve()
    for place in (at, *at.parents):
        f = place / name
        if f.is_file():
            out: dict = {}
            for line in f.read_text(encoding="utf-8").splitlines():
                key, colon, value = line.partition(":")
                if colon and not line.lstrip().startswith("#"):
                    out[key.strip()] = value.strip().strip("\"'")
            return out
    return {}


def schema_to_text(schema: T.StructType) -> str:
    """A schema as YAML: for each column its type (that of its elements for a list) and whether it is a list."""
    out = []
    for f in schema:
        is_list = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if is_list else f.dataType
        out.append(f"{json.dumps(f.name, ensure_ascii=False)}:\n  type: {json.dumps(kind.simpleString())}\n  list: {str(is_list).lower()}\n")
    return "".join(out)


def schema_from_text(text: str) -> T.StructType:
    """The schema that :func:`schema_to_text` wrote; also of names and types without quotes, and of Arrow's names of types."""
    arrow = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "utf8": "string", "large_string": "string", "bool": "boolean", "bool_": "boolean", "date32": "date"}
    fields: list[tuple[str, dict]] = []
    bare = lambda x: json.loads(x) if x.startswith('"') else x.strip("'")
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, _, value = (line.rpartition(":") if line.rstrip().endswith(":") else line.partition(": "))
        if not line[0].isspace():
            fields.append((bare(key.strip()), {}))
        else:
            fields[-1][1][key.strip()] = bare(value.strip())
    out = []
    for name, about in fields:
        kind = about.get("type") or about.get("arrow_type") or "string"
        kind = arrow.get(kind, kind)
        out.append(f"`{name.replace('`', '``')}` {f'array<{kind}>' if about.get('list') == 'true' else kind}")
    return T._parse_datatype_string(", ".join(out)) if out else T.StructType([])


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """A stored schema; empty if there is none."""
    return schema_from_text(files.read_text(path, spark)) if files.exists(path, spark) else T.StructType([])


def write_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    files.write_text(path, schema_to_text(schema), spark)
