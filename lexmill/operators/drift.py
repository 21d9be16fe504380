"""Schemas that drift between the files of a feed: tagged-union inference.

Every line is parsed once and stays one row: a map from its keys to values tagged
with their shape, the full nested type.  The shapes of each key are counted per
file, and flattened to paths (``k``, ``k.inner``, ``k[]``), each with all its
alternative types kept apart.  Consecutive files of a feed are then compared:
fields that appear, disappear, change type, or go on under another key, and
within a field paths and alternative types that appear or go.  A renamed field is
found by content: the values' shapes and words of a key that went and of one
that came are matched by joins on (feed, file, feature), never by comparing
values pairwise.

The consistent table follows fields through their renames, keeps each typed
branch of a field, and converts all branches to the field's canonical type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import cut, shuffle_width

TYPES = ["array", "boolean", "float", "integer", "object", "string"]
MISSING = ["", "NA"]
#: Lines of one file that a task reads; a longer file goes to several.
BLOCK_LINES = 1 << 16
#: What tells one whole line from another.
LINE = ["feed", "file_no", "line_no", "__line"]


@dataclass(frozen=True)
class Likeness:
    """When two keys hold the same content."""

    shape: float = 0.4
    words: float = 0.1
    #: Difference of the shares of the lines with the key that have a value, and how much more of it few lines allow (over the root of their number).
    filled_apart: float = 0.3
    filled_apart_few: float = 0.6
    #: With so few values words say little, then a telling shape must do.
    few: int = 6
    few_shape: float = 0.95


def type_tag(shape: Column) -> Column:
    """Type as one of TYPES of a value's shape (``schema_of_variant``), null for a JSON null."""
    return (
        F.when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer")
        .when(shape == "STRING", "string")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "float")
    )


_SCALARS = {"BOOLEAN": "boolean", "BIGINT": "integer", "STRING": "string", "VOID": None, "DOUBLE": "float", "FLOAT": "float", "VARIANT": "mixed"}
_NAME = re.compile(r"`(?:[^`]|``)*`|[^:`<>,]+")


@lru_cache(maxsize=1 << 14)
def shape_paths(shape: str) -> tuple[tuple[str, str], ...]:
    """(path, type) of all parts of a shape; the path of the whole is '', of an inner key '.key', of an array's elements '[]' ('mixed' where they differ); of a shape nested too deep to read, the whole only."""
    out: list[tuple[str, str]] = []

    def read(at: int, path: str) -> int:
        if shape.startswith("ARRAY<", at):
            out.append((path, "array"))
            return read(at + 6, path + "[]") + 1
        if shape.startswith("OBJECT<", at):
            out.append((path, "object"))
            at += 7
            while shape[at] != ">":
                name = _NAME.match(shape, at)
                at = name.end() + 2  # past the colon and a blank
                plain = name.group()
                at = read(at, f"{path}.{plain[1:-1].replace('``', '`') if plain[0] == '`' else plain}")
                if shape.startswith(", ", at):
                    at += 2
            return at + 1
        end = re.compile(r"[A-Z]+(?:\(\d+,\s*\d+\))?(?:_[A-Z]+)*").match(shape, at).end()
        kind = shape[at:end]
        kind = "float" if kind.startswith("DECIMAL") else _SCALARS.get(kind, kind.lower())
        if kind is not None:
            out.append((path, kind))
        return end

    try:
        read(0, "")
    except RecursionError:
        del out[1:]
    return tuple(dict.fromkeys(out))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``line_no``, ``__line`` (a hash of the text) and ``fields`` (map key -> shape, value) of every line that is a whole JSON object.

    Shape and value (text) are null for null, '' and 'NA'.  Rows equal in feed,
    numbers and text count once; line numbers may be null or repeated.
    """
    held = lines.select("feed", "file_no", "line_no", "line").filter(F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    # equal lines meet, and those of one file, a stretch at a time, so that little is left to add up by file
    block = F.coalesce(F.floor(F.col("line_no") / BLOCK_LINES), F.pmod(F.xxhash64("line"), F.lit(64)))
    once = held.withColumn("__block", block).repartition(shuffle_width(lines.sparkSession), "feed", "file_no", "__block").distinct()
    v = once.select("feed", "file_no", "line_no", F.xxhash64("line").alias("__line"), F.expr("try_parse_json(line)").alias("v"))
    whole = v.filter(F.col("v").isNotNull()).withColumn("v", F.when(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.col("v"))).filter(F.col("v").isNotNull())

    def tagged(_: Column, x: Column) -> Column:
        shape, value = F.schema_of_variant(x), x.cast("string")
        there = (shape != "VOID") & ~((shape == "STRING") & value.isin(MISSING))
        return F.when(there, F.struct(shape.alias("shape"), value.alias("value")))

    return whole.select(*LINE, F.transform_values(F.expr("cast(v as map<string,variant>)"), tagged).alias("fields"))


def tagged_values(lines: DataFrame) -> DataFrame:
    """One row per line and key: ``feed``, ``file_no``, ``line_no``, ``__line``, ``key``, ``type``, ``value`` (text); type and value are null for null, '' and 'NA'.

    A whole line without keys has one row, whose key is null.
    """
    flat = parsed_lines(lines).select(*LINE, F.explode_outer("fields").alias("key", "x"))
    return flat.select(*LINE, "key", type_tag(F.col("x.shape")).alias("type"), "x.value")


def counted_shapes(parsed: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``key``, ``shape``, ``n``: how often each shape of a key occurs in each file; a null shape counts missing values, a null key lines without keys."""
    flat = parsed.select("feed", "file_no", F.explode_outer("fields").alias("key", "x"))
    return flat.groupBy("feed", "file_no", "key", F.col("x.shape").alias("shape")).agg(F.count("*").alias("n"))


def file_schemas(counted: DataFrame) -> DataFrame:
    """The fused schema of each file from its counted shapes: ``feed``, ``file_no``, ``seq``, ``key``, ``filled``, ``present``, ``alternatives`` (type -> values), ``type``.

    ``type`` is that of most values (of equals the first by name); without any
    value the key keeps its last type in the feed.  ``seq`` numbers the files of
    a feed that hold a whole line; one of lines without keys has a row with a null key.
    """
    tag, n = type_tag(F.col("shape")), F.col("n")
    count = lambda t: F.coalesce(F.sum(F.when(tag == t, n)), F.lit(0))
    keys = counted.groupBy("feed", "file_no", "key").agg(F.coalesce(F.sum(F.when(F.col("shape").isNotNull(), n)), F.lit(0)).alias("filled"), F.sum("n").alias("present"), *[count(t).alias(f"n_{t}") for t in TYPES])
    best = F.array_max(F.array(*[F.struct(F.col(f"n_{t}").alias("n"), F.lit(-i).alias("o")) for i, t in enumerate(TYPES)]))
    major = F.when(best["n"] > 0, F.element_at(F.array(*map(F.lit, TYPES)), F.lit(1) - best["o"]))
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n_{t}").alias("n")) for t in TYPES])
    held = F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))
    keys = keys.select("feed", "file_no", "key", "filled", "present", held.alias("alternatives"), major.alias("major"))
    history = W.partitionBy("feed", "key").orderBy("file_no").rowsBetween(W.unboundedPreceding, 0)
    keys = keys.withColumn("type", F.last("major", ignorenulls=True).over(history)).drop("major")
    keys = keys.withColumn("seq", F.dense_rank().over(W.partitionBy("feed").orderBy("file_no")))
    with_keys = F.max(F.col("key").isNotNull()).over(W.partitionBy("feed", "file_no"))
    return keys.withColumn("__keys", with_keys).filter(F.col("key").isNotNull() | ~F.col("__keys")).drop("__keys")


def counted_paths(counted: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``key``, ``path`` (within the key, '' for itself), ``type``, ``n``: values that hold each alternative type of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shape_paths(x) for x in batch.column("shape").to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            rest = [batch.column(c).take(at) for c in ("feed", "file_no", "key", "n")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([p for f in found for p, _ in f], pa.string()), pa.array([t for f in found for _, t in f], pa.string())], names=["feed", "file_no", "key", "n", "path", "type"])

    rows = counted.filter("key is not null and shape is not null").select("feed", "file_no", "key", "n", "shape")
    flat = rows.mapInArrow(run, "feed string, file_no long, key string, n long, path string, type string")
    return flat.groupBy("feed", "file_no", "key", "path", "type").agg(F.sum("n").alias("n"))


def _steps(schemas: DataFrame) -> DataFrame:
    """Keys of each file beside those of the file before it: ``old_type``/``type`` with ``here`` and ``before``; the first file of a feed is left out."""
    keys = schemas.filter("key is not null")
    now = keys.select("feed", "seq", "file_no", "key", "type", "present", F.lit(True).alias("here"))
    then = keys.select("feed", (F.col("seq") + 1).alias("seq"), "key", F.col("type").alias("old_type"), F.col("present").alias("old_present"), F.lit(True).alias("before"))
    files = schemas.select("feed", "seq", "file_no").distinct().withColumnRenamed("file_no", "at")
    both = now.join(then, ["feed", "seq", "key"], "full").join(files, ["feed", "seq"])  # a key that went has no file of its own
    return both.filter("seq > 1").withColumn("file_no", F.col("at")).drop("at")


def plain_text(value: Column) -> Column:
    """Content of a value whatever its type: keys and brackets of JSON dropped, separators made alike."""
    bare = F.regexp_replace(value, r'"[^"]*":', "")
    bare = F.regexp_replace(bare, r'^[\[{]+|[\]}]+$|"', "")
    return F.regexp_replace(bare, r"\s*[|;,/]\s*", ", ")


def value_shape(text: Column) -> Column:
    """Capitals, small letters and digits as X, x and 9; runs of small letters as one, of digits as four at most."""
    s = F.regexp_replace(text, r"\p{Lu}", "X")
    s = F.regexp_replace(s, r"[\p{L}\p{M}&&[^X]]+", "x")
    s = F.regexp_replace(s, r"X(?:X|x)*", "Xx")
    return F.regexp_replace(F.regexp_replace(s, r"\d", "9"), r"9{4,}", "9999")


#: Rows of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def _sized(side: DataFrame) -> DataFrame:
    """A stored side of a join, broadcast if its rows, which are counted, are few."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _renames(parsed: DataFrame, steps: DataFrame, files: DataFrame, like: Likeness) -> DataFrame:
    """``feed``, ``seq``, ``old_key``, ``key`` of fields that go on under another key."""
    went = steps.filter("here is null").select("feed", "seq", "key", "old_present")
    came = steps.filter("before is null").select("feed", "seq", "key", "present")
    moved = went.select("feed", "seq").distinct().join(came.select("feed", "seq").distinct(), ["feed", "seq"])
    went, came = cut(went.join(moved, ["feed", "seq"])), cut(came.join(moved, ["feed", "seq"]))
    # the few keys that moved, by the file that holds their values: the one before for those that went
    role = lambda here, at: F.struct(F.col("key"), F.col("seq"), F.lit(here).alias("here"), at.alias("at"))
    wanted = went.select("feed", role(False, F.col("seq") - 1).alias("w")).unionByName(came.select("feed", role(True, F.col("seq")).alias("w")))
    wanted = wanted.join(files.select("feed", "file_no", F.col("seq").alias("at")), (wanted["feed"] == files["feed"]) & (F.col("w.at") == F.col("at"))).select(files["feed"], "file_no", "w")
    wanted = cut(wanted.groupBy("feed", "file_no").agg(F.collect_list("w").alias("wanted")))  # keys of one file
    held = parsed.join(_sized(wanted), ["feed", "file_no"])
    mine = held.select("feed", "fields", F.explode("wanted").alias("w")).select("feed", "w.*", F.element_at("fields", F.col("w.key"))["value"].alias("value")).filter("value is not null")
    mine = mine.select("feed", "seq", "here", "key", plain_text(F.col("value")).alias("text")).filter("text <> ''")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    marks = F.concat(F.array(F.concat(F.lit("s:"), value_shape(F.col("text")))), F.transform(words, lambda w: F.concat(F.lit("w:"), w)))
    features = mine.select("feed", "seq", "here", "key", F.explode(marks).alias("tag")).groupBy("feed", "seq", "here", "key", "tag").agg(F.count("*").alias("n"))
    tags = cut(features)
    old = tags.filter("not here").select("feed", "seq", F.col("key").alias("old_key"), "tag", F.col("n").alias("n_old"))
    new = tags.filter("here").select("feed", "seq", "key", "tag", F.col("n").alias("n_new"))
    shape = F.col("tag").startswith("s:")
    norm = lambda df, n, k: df.groupBy("feed", "seq", k).agg(
        F.sqrt(F.sum(F.when(shape, F.col(n) * F.col(n)))).alias(f"{n}_norm"), F.sum(F.when(~shape, F.col(n))).alias(f"{n}_words"), F.max(F.when(shape, F.length("tag") - 2)).alias(f"{n}_long"), F.sum(F.when(shape, F.col(n))).alias(f"{n}_filled")
    )
    met = old.join(new, ["feed", "seq", "tag"]).groupBy("feed", "seq", "old_key", "key").agg(
        F.coalesce(F.sum(F.when(shape, F.col("n_old") * F.col("n_new"))), F.lit(0)).alias("dot"),
        F.coalesce(F.sum(F.when(~shape, F.col("n_old"))), F.lit(0)).alias("old_met"),
        F.coalesce(F.sum(F.when(~shape, F.col("n_new"))), F.lit(0)).alias("new_met"),
    )
    met = met.join(norm(old, "n_old", "old_key"), ["feed", "seq", "old_key"]).join(norm(new, "n_new", "key"), ["feed", "seq", "key"])
    met = met.join(went.withColumnRenamed("key", "old_key"), ["feed", "seq", "old_key"]).join(came, ["feed", "seq", "key"])
    shapes = F.col("dot") / (F.col("n_old_norm") * F.col("n_new_norm"))
    words = (F.coalesce(F.col("old_met") / F.col("n_old_words"), F.lit(0.0)) + F.coalesce(F.col("new_met") / F.col("n_new_words"), F.lit(0.0))) / 2
    filled = F.abs(F.col("n_old_filled") / F.col("old_present") - F.col("n_new_filled") / F.col("present"))
    few = (F.least("n_old_filled", "n_new_filled") < like.few) & (F.least("n_old_long", "n_new_long") >= 4) & (shapes >= like.few_shape)
    apart = like.filled_apart + like.filled_apart_few / F.sqrt(F.least("old_present", "present"))
    alike = (filled <= apart) & (((shapes >= like.shape) & (words >= like.words)) | few)
    scored = met.filter(alike).select("feed", "seq", "old_key", "key", (shapes + words - filled).alias("score"))

    # the most alike first, every key once; a group is the few alike keys of one file
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("apart"), "old_key", "key")))
    start = F.struct(F.array().cast("array<string>").alias("old"), F.array().cast("array<string>").alias("new"))

    def take(taken: Column, pair: Column) -> Column:
        free = ~F.array_contains(taken["old"], pair["old_key"]) & ~F.array_contains(taken["new"], pair["key"])
        more = F.struct(F.concat(taken["old"], F.array(pair["old_key"])).alias("old"), F.concat(taken["new"], F.array(pair["key"])).alias("new"))
        return F.when(free, more).otherwise(taken)

    chosen = scored.groupBy("feed", "seq").agg(ordered.alias("pairs")).select("feed", "seq", F.aggregate("pairs", start, take).alias("t"))
    return chosen.select("feed", "seq", F.explode(F.arrays_zip(F.col("t.old").alias("old_key"), F.col("t.new").alias("key"))).alias("z")).select("feed", "seq", "z.old_key", "z.key")


def schema_changes(lines: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Every change of fields from a file to the next of its feed: ``feed``, ``file_no``, ``change_kind``, ``field``, ``old_field``, ``old_type``, ``new_type``.

    Kinds are added, removed, renamed and retyped (a field renamed and retyped at
    once gives both).  Lines that aren't whole JSON objects, and lines without
    feed or file number, are left out; files without a whole line are passed
    over, and in a file of lines without keys (``{}``) every field is removed.  Keys are told apart by case.  The order of arrival and of lines
    doesn't matter, repeated lines count once.  An empty table gives no rows.
    """
    parsed = cut(parsed_lines(lines))
    return _changes(parsed, cut(counted_shapes(parsed)), like)[0]


def change_report(lines: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The changes of fields and those within them; columns and cases as of :func:`schema_changes`.

    Within a field, which is compared with what it was called before, the kinds
    are alternative_added and alternative_removed (a type that some values of a
    path take up or give up, beside the types that stay or in their place), and
    path_added and path_removed (an inner key of objects that both files have);
    ``field`` is the path there: ``key``, ``key.inner``, ``key[]``.
    """
    parsed = cut(parsed_lines(lines))
    counted = cut(counted_shapes(parsed))
    fields, renames, schemas = _changes(parsed, counted, like)
    return fields.unionByName(_alternatives(counted, cut(_files(schemas)), renames))


def _files(schemas: DataFrame) -> DataFrame:
    return schemas.select("feed", "file_no", "seq").distinct()


def _alternatives(counted: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """Paths and types that appear or go within a field, renamed fields compared with what they were."""
    paths = counted_paths(counted).join(files, ["feed", "file_no"])
    now = paths.select("feed", "seq", "key", "path", "type", F.lit(True).alias("here"))
    went = renames.select("feed", "seq", F.col("old_key").alias("key"), F.col("key").alias("new_key"))
    then = paths.select("feed", (F.col("seq") + 1).alias("seq"), "key", "path", "type").join(went, ["feed", "seq", "key"], "left")
    then = then.select("feed", "seq", F.coalesce("new_key", "key").alias("key"), F.col("key").alias("old_key"), "path", "type", F.lit(True).alias("before"))
    both = now.join(then, ["feed", "seq", "key", "path", "type"], "full")
    by_path = both.groupBy("feed", "seq", "key", "path").agg(F.bool_or(F.coalesce("here", F.lit(False))).alias("here"), F.bool_or(F.coalesce("before", F.lit(False))).alias("before"), F.max("old_key").alias("old_key"), F.collect_list(F.struct("type", F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("before", F.lit(False)).alias("before"))).alias("types"))  # no more than types
    parent = F.regexp_replace("path", r"(?:\.[^.\[\]]*|\[\])$", "")
    inner = F.col("path") != ""
    held = by_path.withColumn("parent", F.when(inner, parent))
    objects = both.filter("here and before and type = 'object'").select("feed", "seq", "key", F.col("path").alias("parent"), F.lit(True).alias("kept"))
    named = held.join(objects, ["feed", "seq", "key", "parent"], "left").join(files.withColumnRenamed("file_no", "at"), ["feed", "seq"])
    name = F.concat("key", "path")
    old_name = F.concat(F.coalesce("old_key", "key"), F.col("path"))
    row = lambda df, kind, old_type, new_type: df.select("feed", F.col("at").alias("file_no"), kind.alias("change_kind"), name.alias("field"), old_name.alias("old_field"), old_type.alias("old_type"), new_type.alias("new_type"))
    none = F.lit(None).cast("string")
    moved = named.filter(inner & F.col("kept") & (F.col("here") != F.col("before")) & F.col("path").rlike(r"\.[^.\[\]]*$"))
    listed = F.array_join(F.array_sort(F.transform("types", lambda t: t["type"])), "|")
    inner_rows = row(moved, F.when(F.col("here"), "path_added").otherwise("path_removed"), F.when(F.col("before"), listed), F.when(F.col("here"), listed))
    changed = named.filter("here and before").select("*", F.explode(F.filter("types", lambda t: t["here"] != t["before"])).alias("t"))
    return inner_rows.unionByName(row(changed, F.when(F.col("t.here"), "alternative_added").otherwise("alternative_removed"), F.when(F.col("t.before"), F.col("t.type")).otherwise(none), F.when(F.col("t.here"), F.col("t.type")).otherwise(none)))


def _changes(parsed: DataFrame, counted: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame, DataFrame]:
    schemas = cut(file_schemas(counted))
    files = cut(_files(schemas))
    steps = cut(_steps(schemas))
    renames = cut(_renames(parsed, steps, files, like))
    kept = steps.filter("here and before and old_type <> type").select("feed", "file_no", F.lit("retyped").alias("change_kind"), F.col("key").alias("field"), F.col("key").alias("old_field"), "old_type", F.col("type").alias("new_type"))
    old = steps.filter("here is null").select("feed", "seq", "file_no", F.col("key").alias("old_key"), "old_type")
    new = steps.filter("before is null").select("feed", "seq", "file_no", "key", "type")
    moved = renames.join(old.drop("file_no"), ["feed", "seq", "old_key"]).join(new, ["feed", "seq", "key"])
    row = lambda df, kind, field: df.select("feed", "file_no", F.lit(kind).alias("change_kind"), F.col(field).alias("field"), F.col("old_key").alias("old_field"), "old_type", F.col("type").alias("new_type"))
    added = new.join(renames.select("feed", "seq", "key"), ["feed", "seq", "key"], "left_anti").withColumns({"old_key": F.lit(None).cast("string"), "old_type": F.lit(None).cast("string")})
    removed = old.join(renames.select("feed", "seq", "old_key"), ["feed", "seq", "old_key"], "left_anti").withColumns({"type": F.lit(None).cast("string")})
    parts = [row(moved, "renamed", "key"), row(moved.filter("old_type <> type"), "retyped", "key"), row(added, "added", "key"), row(removed, "removed", "old_key")]
    out = kept
    for part in parts:
        out = out.unionByName(part)
    return out, renames, schemas


# -- one table ------------------------------------------------------------------


def _field_spans(steps: DataFrame, renames: DataFrame) -> DataFrame:
    """``feed``, ``key``, ``since``, ``until``, ``field``: where a key stands for a field that began under another name."""
    moved = renames.select("feed", "seq", "old_key", "key")
    ended = steps.filter("here is null").select("feed", "seq", F.col("key").alias("old_key")).join(renames.select("feed", "seq", "old_key"), ["feed", "seq", "old_key"], "left_anti").select("feed", "seq", "old_key", F.lit(None).cast("string").alias("key"))
    touched = moved.select("feed").distinct()

    def follow(events: pd.DataFrame) -> pd.DataFrame:
        origin: dict[str, tuple[str, int]] = {}
        rows = []
        for seq, group in events.groupby("seq", sort=True):
            left = {}
            for e in group.itertuples():
                left[e.old_key] = origin.pop(e.old_key, None)
                if left[e.old_key]:
                    field, since = left[e.old_key]
                    rows.append((e.feed, e.old_key, since, int(seq), field))
            for e in group[group["key"].notna()].itertuples():
                origin[e.key] = (left[e.old_key][0] if left[e.old_key] else e.old_key, int(seq))
        feed = events["feed"].iloc[0]
        rows += [(feed, key, since, 2**31 - 1, field) for key, (field, since) in origin.items()]
        return pd.DataFrame(rows, columns=["feed", "key", "since", "until", "field"])

    events = moved.unionByName(ended).join(touched, "feed")
    return events.groupBy("feed").applyInPandas(follow, "feed string, key string, since int, until int, field string")  # a group is the changes of one feed


#: What a canonical type is in the table.
COLUMN_TYPES = {"array": "array<string>", "boolean": "boolean", "float": "double", "integer": "bigint", "object": "string", "string": "string"}


def to_canonical(kind: Column, value: Column, canonical: str) -> Column:
    """A value of any type as the canonical type of its field; null where it can't be."""
    listed = F.from_json(value, "array<string>")
    named = F.from_json(value, "map<string,string>")
    inner = F.when(named["last"].isNotNull() & named["first"].isNotNull(), F.concat_ws(", ", named["last"], named["first"])).otherwise(F.array_join(F.map_values(named), ", "))
    text = F.when(kind == "array", F.array_join(listed, "; ")).when(kind == "object", inner).otherwise(value)
    if canonical == "array":
        return F.when(kind == "array", listed).when(kind == "string", F.split(value, r"\s*[|;]\s*|,\s+")).otherwise(F.array(text))
    if canonical == "boolean":
        return F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False)
    return text.try_cast(COLUMN_TYPES[canonical])


def consistent_table(lines: DataFrame, like: Likeness = Likeness()) -> tuple[DataFrame, DataFrame]:
    """All lines in one table, and the report of changes.

    The table has ``feed``, ``file_no``, ``line_no`` and, for every field by the
    name it began with in its feed, a column of its canonical type (that of most
    of its values anywhere) and for each other type that occurs a branch
    ``{field}__{type}`` with the value as it came (JSON text).  Names of columns
    that differ only by case get a number.  Lines that aren't whole are left out.
    Every whole line has a row of its own, also without keys and where line
    numbers are null or repeated; lines equal in number and text are one.
    """
    parsed = cut(parsed_lines(lines))
    counted = cut(counted_shapes(parsed))
    changes, renames, schemas = _changes(parsed, counted, like)
    files = cut(_files(schemas))
    changes = changes.unionByName(_alternatives(counted, files, renames))
    spans = cut(_field_spans(_steps(schemas), renames))  # of renamed fields
    spans = files.join(spans, "feed").filter((F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("until"))).select("feed", "file_no", "key", "field")
    # the field of each key of each file; two keys of one file never share a field
    keys = schemas.filter("key is not null").select("feed", "file_no", "key").join(spans, ["feed", "file_no", "key"], "left").withColumn("field", F.coalesce("field", "key"))
    turn = F.row_number().over(W.partitionBy("feed", "file_no", "field").orderBy((F.col("key") == F.col("field")).cast("int"), "key"))
    keys = cut(keys.withColumn("turn", turn).withColumn("field", F.when(F.col("turn") > 1, F.concat_ws("__again", "field", F.when(F.col("turn") > 2, F.col("turn").cast("string")).otherwise(""))).otherwise(F.col("field"))).drop("turn"))
    # how often each type of each field occurs: from the counts by file, not from the lines
    typed = counted.filter("key is not null").select("feed", "file_no", "key", type_tag(F.col("shape")).alias("type"), "n").join(keys, ["feed", "file_no", "key"])
    kinds: dict[str, dict[str, int]] = {}
    for r in typed.groupBy("field", "type").agg(F.sum("n").alias("n")).collect():  # fields x types
        kinds.setdefault(r["field"], {})[r["type"]] = r["n"]
    # every line keeps its place: keys that stand for a field of another name are looked up by file
    moved = keys.filter("key <> field").groupBy("feed", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "key"))).alias("__moved"))  # fields of one file
    placed = parsed.join(_sized(cut(moved)), ["feed", "file_no"], "left").withColumn("__moved", F.coalesce("__moved", F.create_map().cast("map<string,string>")))
    placed = placed.withColumn("__taken", F.map_values("__moved"))
    columns, seen = [], set(LINE)

    def name(wanted: str) -> str:
        out, k = wanted, 2
        while out.lower() in seen:
            out, k = f"{wanted}_{k}", k + 1
        seen.add(out.lower())
        return out

    wide = []
    for i, field in enumerate(sorted(kinds)):
        types = {t: n for t, n in kinds[field].items() if t is not None}
        canonical = min(types, key=lambda t: (-types[t], t)) if types else "string"
        key = F.element_at("__moved", F.lit(field))
        own = F.when(~F.array_contains("__taken", F.lit(field)), F.element_at("fields", F.lit(field)))  # unless it stands for another field there
        wide.append(F.coalesce(F.element_at("fields", key), own).alias(f"__f{i}"))
        x = F.col(f"__f{i}")
        kind = type_tag(x["shape"])
        columns.append(F.when(x.isNotNull(), to_canonical(kind, x["value"], canonical)).alias(name(field)))
        columns += [F.when(kind == t, x["value"]).alias(name(f"{field}__{t}")) for t in sorted(types) if t != canonical]
    table = placed.select(*LINE, *wide).select(*[c for c in LINE if c != "__line"], *(columns or [F.lit(0).alias("values")]))
    return table, changes
