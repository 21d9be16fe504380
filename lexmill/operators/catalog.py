"""Catalog typing: the narrowest form of each column, dictionaries, quantiles, ids.

All columns of a table are judged by one aggregation pass, and cast by one
projection.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import DATE_LIKE, common_prefix
from lexmill.operators.features import ID, global_rank
from lexmill.session import cut, shuffle_width

ID_NAMES = ["@id", "filename", "id"]
QUANTILES = [0.0, 0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995, 1.0]
DATE_SHARE = 0.95
DICTIONARY_SHARE = 0.5
TOP_VALUES = 10

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGERS = [("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)]


def _q(name: str) -> str:
    return f"`{name}`"


def infer_id_field(df: DataFrame) -> str:
    """The first column if it has an id's name, else the first column that has; ``ValueError`` without one."""
    for name in df.columns:
        if name in ID_NAMES:
            return name
    raise ValueError(f"no column is named {', '.join(ID_NAMES)}; name the id field")


def duplicate_ids(df: DataFrame, id: str) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return df.groupBy(F.col(_q(id)).alias(id)).agg(F.count("*").alias("count")).filter("count > 1")


def assign_ids(df: DataFrame, id: str | None = None, order: list[str] | None = None, strict: bool = True) -> DataFrame:
    """``df`` with its id field as string ``@id`` and the dense number ``nc:id`` of its rows in a stated order (that of ids by default)."""
    id = id or infer_id_field(df)
    if strict and (n := duplicate_ids(df, id).count()):
        raise ValueError(f"{n} ids of {id!r} aren't unique")
    named = df.withColumnRenamed(id, "@id").withColumn("@id", F.col("`@id`").cast("string"))
    return global_rank(named, [F.col(_q(c)) for c in (order or ["@id"])], ID)


def stack_of(batch_size: int) -> Column:
    """Number of the stack (slice of ``batch_size`` documents) that a row belongs to."""
    return F.floor(F.col(_q(ID)) / batch_size).cast("long")


@dataclass
class ColumnForm:
    """What a column was found to be."""

    name: str
    form: str
    spark_type: str
    is_list: bool = False
    distinct: int = 0
    total: int = 0
    quantiles: dict = field(default_factory=dict)
    top_values: list = field(default_factory=list)


def _leaf(df: DataFrame, name: str) -> tuple[T.DataType, bool]:
    t = df.schema[name].dataType
    return (t.elementType, True) if isinstance(t, T.ArrayType) else (t, False)


def integer_like(c: Column) -> Column:
    """Digits with an optional minus, as strict as a lossless cast: no plus sign, blanks or fraction; null for null."""
    return F.when(c.isNotNull(), c.cast("string").rlike(r"^-?[0-9]{1,19}$") & c.try_cast("bigint").isNotNull())


def float_like(c: Column) -> Column:
    return c.cast("string").rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")


def date_share(c: Column) -> Column:
    """Share of non-null values that look like a date."""
    return F.avg(c.cast("string").rlike(DATE_LIKE).cast("double"))


def _all(p: Column) -> Column:
    return F.coalesce(F.bool_and(p), F.lit(True))


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """``column``, ``distinct`` (null counts as a value), ``total`` in one pass."""
    count = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.countDistinct(c))
    exprs = []
    for c in columns:
        x = F.col(_q(c))
        exprs.append(F.struct(F.lit(c).alias("column"), (count(x) + F.max(x.isNull().cast("int"))).cast("long").alias("distinct"), F.count("*").alias("total")).alias(c))
    row = df.agg(*exprs)
    return row.select(F.inline(F.array(*[F.col(_q(c)) for c in columns])))


def infer_forms(df: DataFrame, id: str | None = None, bool_as_int: bool = False, dictionary_share: float = DICTIONARY_SHARE) -> dict[str, ColumnForm]:
    """The form of every column from one aggregate over the table.

    In this order: id -> string; integer of the narrowest width (numbers and
    digit strings; booleans only with ``bool_as_int``); float; date (over 95 %
    date-like); dictionary (fewer than half as many values as rows); else as it
    is.  Lists are judged by their elements.  Structs pass through; a column
    without any value is a string.
    """
    exprs, judged = [], {}
    for name in df.columns:
        leaf, is_list = _leaf(df, name)
        if isinstance(leaf, (T.StructType, T.MapType, T.BinaryType, T.ArrayType, *_DATES)) or name in (id, ID):
            continue
        x = F.col(_q(name))
        if isinstance(leaf, T.BooleanType):
            x = F.transform(x, lambda v: v.cast("int")) if is_list else x.cast("int")
        each = (lambda p, x=x: F.forall(x, lambda v: F.coalesce(p(v), F.lit(True)))) if is_list else (lambda p, x=x: p(x))
        low = F.array_min(F.transform(x, lambda v: v.try_cast("bigint"))) if is_list else x.try_cast("bigint")
        high = F.array_max(F.transform(x, lambda v: v.try_cast("bigint"))) if is_list else low
        share = date_share(x) if not is_list else F.avg(F.forall(x, lambda v: v.cast("string").rlike(DATE_LIKE)).cast("double"))
        judged[name] = (leaf, is_list)
        exprs.append(
            F.struct(
                _all(each(integer_like)).alias("int"), _all(each(float_like)).alias("float"), F.min(low).alias("low"), F.max(high).alias("high"), share.alias("dates"), F.count(x).alias("n"),
                (F.approx_count_distinct(x) + F.max(x.isNull().cast("int"))).alias("distinct"), F.count("*").alias("total"),
            ).alias(name)
        )
    found = df.agg(*exprs).first().asDict() if exprs else {}
    forms = {}
    for name in df.columns:
        leaf, is_list = _leaf(df, name)
        wrap = lambda t, is_list=is_list: f"array<{t}>" if is_list else t
        if name == id:
            forms[name] = ColumnForm(name, "id", "string")
            continue
        if name == ID:
            forms[name] = ColumnForm(name, "id", "bigint")
            continue
        if isinstance(leaf, _DATES):
            forms[name] = ColumnForm(name, "date", wrap("date"), is_list)
            continue
        if name not in judged:
            forms[name] = ColumnForm(name, "raw", df.schema[name].dataType.simpleString(), is_list)
            continue
        s = found[name]
        form = ColumnForm(name, "raw", df.schema[name].dataType.simpleString(), is_list, s["distinct"] or 0, s["total"])
        is_bool = isinstance(leaf, T.BooleanType)
        if not s["n"]:
            form.form, form.spark_type = "empty", wrap("string")
        elif is_bool and not bool_as_int:
            form.form, form.spark_type = "boolean", wrap("boolean")
        elif s["int"]:
            low, high = s["low"] or 0, s["high"] or 0
            width = next(t for t, bits in _INTEGERS if -(2**bits) <= low and high < 2**bits)
            form.form, form.spark_type = "integer", wrap(width)
        elif s["float"]:
            form.form, form.spark_type = "float", wrap("float" if not isinstance(leaf, T.DoubleType) else "double")
        elif (s["dates"] or 0) > DATE_SHARE:
            form.form, form.spark_type = "date", wrap("date")
        elif not is_list and s["total"] and s["distinct"] / s["total"] < dictionary_share:
            form.form, form.spark_type = "dictionary", "string"
        elif isinstance(leaf, T.StringType):
            form.form = "string"
        forms[name] = form
    return forms


def typed(df: DataFrame, forms: dict[str, ColumnForm]) -> DataFrame:
    """``df`` cast to its forms in one projection, with the form in each column's metadata."""
    out = []
    for name in df.columns:
        f, x = forms[name], F.col(_q(name))
        if f.form == "date" and isinstance(_leaf(df, name)[0], T.StringType):
            x = F.transform(x, lambda v: F.try_to_date(v, "y-M-d")) if f.is_list else F.try_to_date(x, "y-M-d")
        elif f.spark_type != df.schema[name].dataType.simpleString():
            x = x.cast(f.spark_type)
        about = {"form": f.form}
        if f.quantiles:
            about["quantiles"] = json.dumps(f.quantiles, default=str)
        if f.top_values:
            about["top_values"] = json.dumps(f.top_values, default=str)
        out.append(x.alias(name, metadata=about))
    return df.select(*out)


def frequency_dictionary(df: DataFrame, column: str) -> DataFrame:
    """``{column}__id``, ``{column}``: the values by falling frequency, of equals the smaller first; null has no code."""
    counts = df.filter(F.col(_q(column)).isNotNull()).groupBy(F.col(_q(column)).alias(column)).agg(F.count("*").alias("__n"))
    ranked = global_rank(counts, [F.desc("__n"), F.asc(_q(column))], f"{column}__id")
    return ranked.select(f"{column}__id", F.col(_q(column)), F.col("__n").alias("count"))


def code_type(values: int) -> str:
    """Width of a dictionary's codes."""
    return "tinyint" if values < 128 else "smallint" if values < 32768 else "int"


def dictionary_encode(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``{column}__id`` in place of ``column``."""
    codes = frequency_dictionary(df, column)
    return df.join(codes.drop("count"), column, "left").drop(column)


def quantiles(df: DataFrame, column: str, at: list[float] | None = None, approximate: bool = False) -> DataFrame:
    """``q``, ``value``: linearly interpolated quantiles of a numeric column; for other types the smallest and greatest value."""
    at = at or QUANTILES
    x = F.col(_q(column))
    if isinstance(df.schema[column].dataType, T.NumericType):
        found = F.percentile_approx(x, at, 10_000) if approximate else F.percentile(x, F.array(*map(F.lit, at)))
        return df.agg(found.alias("v")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("v").alias("value"))).alias("z")).select("z.q", "z.value")
    return df.agg(F.min(x).alias("low"), F.max(x).alias("high")).select(F.inline(F.array(F.struct(F.lit(0.0).alias("q"), F.col("low").alias("value")), F.struct(F.lit(1.0).alias("q"), F.col("high").alias("value")))))


def top_values(df: DataFrame, column: str, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values with their counts, of equals the smaller first."""
    return df.filter(F.col(_q(column)).isNotNull()).groupBy(F.col(_q(column)).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def describe(df: DataFrame, forms: dict[str, ColumnForm]) -> dict[str, ColumnForm]:
    """Forms completed with quantiles (numbers, dates) and top values (dictionaries)."""
    shaped = typed(df, forms)
    for name, f in forms.items():
        if f.form in ("integer", "float", "date") and not f.is_list:
            f.quantiles = {str(r["q"]): r["value"] for r in quantiles(shaped, name).collect()}  # nine numbers
        elif f.form == "dictionary":
            f.top_values = [[r["value"], r["count"]] for r in top_values(shaped, name).collect()]  # ten values
    return forms


def wrap_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold arrays in some rows and single values in others (as JSON text) as arrays of strings throughout."""
    out = df
    for c in columns:
        x = F.col(_q(c))
        parsed = F.try_parse_json(x)
        is_array = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
        out = out.withColumn(c, F.when(x.isNull(), F.lit(None)).when(is_array, F.from_json(x, "array<string>")).otherwise(F.array(x)))
    return out


# -- flat catalog -----------------------------------------------------------------


def flat_catalog(df: DataFrame, forms: dict[str, ColumnForm]) -> dict[str, DataFrame]:
    """The catalog as plain relations for a database, all keyed by ``nc:id``.

    ``fastcat`` has numbers, dates and dictionary codes; ``catalog`` everything
    readable; each list column is a table of its own (``nc:id``, value), each
    dictionary a ``{column}Lookup``.
    """
    shaped = typed(df, forms)
    fast, readable, out = [F.col(_q(ID))], [F.col(_q(ID))], {}
    coded = shaped
    for name in df.columns:
        f = forms[name]
        if name == ID:
            continue
        x = F.col(_q(name))
        if f.is_list:
            out[name] = shaped.select(F.col(_q(ID)), F.explode(x).alias(name))
            continue
        readable.append(x)
        if f.form in ("integer", "float", "date", "boolean"):
            fast.append(x)
        elif f.form == "dictionary":
            lookup = frequency_dictionary(shaped, name)
            out[f"{name}Lookup"] = lookup.select(f"{name}__id", F.col(_q(name)))
            coded = coded.join(out[f"{name}Lookup"], name, "left")
            fast.append(F.col(_q(f"{name}__id")))
    out["fastcat"] = coded.select(*fast)
    out["catalog"] = shaped.select(*readable)
    return out


# -- id neighbourhoods ----------------------------------------------------------


def id_distances(df: DataFrame, id: str) -> DataFrame:
    """``id``, ``distance``: leading characters each distinct id shares with the one before it in order; 0 for the first.

    Ids are range-partitioned and sorted in place; the last id of each partition
    (one per task) is handed to the next.
    """
    held = df.select(F.col(_q(id)).cast("string").alias("id")).filter("id is not null").distinct()
    ordered = cut(held.repartitionByRange(shuffle_width(df.sparkSession), "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()))
    last = {r["part"]: r["id"] for r in ordered.groupBy("part").agg(F.max("id").alias("id")).collect()}  # one id per task
    before: dict[int, str | None] = {}
    latest = None
    for part in sorted(last):
        before[part], latest = latest, last[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous: str | None = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            first = previous if begun else before[batch.column("part")[0].as_py()]
            yield pa.RecordBatch.from_arrays([ids, pa.concat_arrays([pa.array([first], ids.type), ids[:-1]])], names=["id", "before"])
            previous, begun = ids[-1].as_py(), True

    return ordered.mapInArrow(run, "id string, before string").select("id", F.coalesce(common_prefix("id", "before"), F.lit(0)).alias("distance"))


def split_points(distances: list[int], min_length: int = 256, max_length: int = 16384) -> list[int]:
    """Where to cut a run of ids so that no piece is longer than ``max_length``: at the smallest distance, the first of equals, ``min_length`` away from both ends."""
    pieces, done = [(0, len(distances))], []
    while pieces:
        a, b = pieces.pop()
        inner = range(a + min_length, b - min_length)
        if b - a <= max_length or not len(inner):
            done.append(a)
            continue
        at = min(inner, key=lambda i: (distances[i], i))
        pieces += [(a, at), (at, b)]
    return sorted(done)


def chunk_ids(df: DataFrame, id: str, min_length: int = 256, max_length: int = 16384) -> DataFrame:
    """``id``, ``chunk``: ids in order in chunks that share prefixes, of at most ``max_length`` ids.

    The recursion runs on the driver, over two bytes for each distinct id; the
    cuts, at most one for every ``min_length`` ids, are looked up by bisection.
    """
    ordered = global_rank(id_distances(df, id), [F.asc("id")], "rank")
    found = array("H", (min(r["distance"], 0xFFFF) for r in ordered.select("rank", "distance").orderBy("rank").toLocalIterator(prefetchPartitions=True)))
    starts = np.array(split_points(found, min_length, max_length), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = np.searchsorted(starts, batch.column("rank").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chunk.astype(np.int64))], names=["id", "chunk"])

    return ordered.select("id", "rank").mapInArrow(run, "id string, chunk long")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (which must leave no ties)."""
    columns = [F.col(_q(c)) for c in df.columns]
    at = F.struct(*[F.col(_q(c)) for c in order])
    best = df.groupBy(F.col(_q(key)).alias("__key")).agg(F.min_by(F.struct(*columns), at).alias("__row"))
    return best.select("__row.*")
