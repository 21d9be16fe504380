"""Problem 1: occurrence and record counts of all n-grams from a distributed suffix array.

The suffixes of all records, each cut to its first ``depth`` words, are put in
order by one range-partitioned sort on (words, record, the other columns).  The
number of leading words that a suffix shares with the one before it (its common
prefix) gives the intervals of every n-gram with n <= depth from that one order:
an interval of n goes on as long as the common prefix is n or more.

* its occurrences are the weights in the interval,
* its records are its suffixes less those that have another of the same record
  in the interval: within-record neighbours, in the order itself for n = depth,
  and after the interval's suffixes are put in order by record for shorter n,
* rows that equal their neighbour in every column are repeats and count once.

The range is taken over all columns, so a word, or a word in one record, that
holds a third of all rows is spread over many tasks, and equal rows still meet.
An interval that lies within a partition is complete when it closes and goes
nowhere else.  One that holds a partition's first or last suffix, or more records
than are kept in memory, may go on elsewhere: it is written by record (for n =
depth only its first and last record, those between are its own) and added up by
(n-gram, record).  There is one shuffle of the suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.unigram_rows import countable, record_count
from lexmill.session import cut, shuffle_width

RECORD, WEIGHT = "__record", "__weight"
#: Records of one interval that a task keeps in memory.
KEPT_RECORDS = 100_000


def _differs(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether an entry differs from the one before it; nulls equal each other; the first differs where nothing is before it."""
    if not len(column):
        return np.zeros(0, dtype=bool)
    previous = pa.concat_arrays([before if before is not None else column[:1], column[:-1]])
    if pa.types.is_nested(column.type):  # compared by value
        out = np.array([x != y for x, y in zip(column.to_pylist(), previous.to_pylist())], dtype=bool)
    else:
        unequal = pc.fill_null(pc.not_equal(column, previous), True)
        both = pc.and_(pc.is_null(column), pc.is_null(previous))
        out = pc.and_(unequal, pc.invert(both)).to_numpy(zero_copy_only=False).copy()
    if before is None:
        out[0] = True
    return out


class _Interval:
    """The interval of one length that is being read, and the rows that are to be written."""

    def __init__(self, n: int, depth: int) -> None:
        self.n, self.in_order = n, n == depth
        self.words: tuple | None = None
        self.rows: list[tuple] = []  # (words, record, count, records, whether it may go on elsewhere)

    def begin(self, words: tuple, at_edge: bool) -> None:
        self.words, self.open, self.count, self.records = words, at_edge, 0, 0
        self.held: set = set()
        self.first = self.last = None

    def add(self, count: int, records: int, some: list) -> None:
        """Weight and records of a stretch; ``some`` are its records (n < depth), or its first and last (n = depth)."""
        self.count += count
        if self.in_order:
            if self.records and some[0] == self.last:
                records -= 1
            self.first = some[0] if not self.records else self.first
            self.records, self.last = self.records + records, some[-1]
            return
        self.held.update(some)
        if len(self.held) > KEPT_RECORDS:
            self.open = True
            self._write_held()

    def _write_held(self) -> None:
        self.rows += [(self.words, r, 0, None, True) for r in self.held]
        self.held = set()

    def end(self, at_edge: bool = False) -> None:
        if self.words is None:
            return
        if not (self.open or at_edge):
            self.rows.append((self.words, None, self.count, self.records if self.in_order else len(self.held), False))
        elif self.in_order:
            edges = {self.first, self.last}
            self.rows.append((self.words, None, self.count, self.records - len(edges), True))
            self.rows += [(self.words, r, 0, None, True) for r in edges]
        else:
            self.rows.append((self.words, None, self.count, 0, True))
            self._write_held()
        self.words = None


def _intervals(batches: Iterator[pa.RecordBatch], lengths: list[int], depth: int, unique: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Intervals of one sorted partition as rows of ``schema``."""
    last: pa.RecordBatch | None = None
    states = {n: _Interval(n, depth) for n in lengths}
    word_names = [f"w{k}" for k in range(depth)]

    def written() -> Iterator[pa.RecordBatch]:
        for n, state in states.items():
            rows, state.rows = state.rows, []
            if rows:
                columns = [[r[0][k] if k < n else None for r in rows] for k in range(depth)] + [[n] * len(rows)] + [[r[i] for r in rows] for i in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        differs = {c: _differs(batch.column(c), last.column(c) if last is not None else None) for c in (batch.schema.names if unique else [*word_names, RECORD])}
        weight = batch.column(WEIGHT).to_numpy(zero_copy_only=False)
        if unique:
            fresh = np.logical_or.reduce(list(differs.values()))
            weight = np.where(fresh, weight, 0)
        record = batch.column(RECORD)
        codes = record.dictionary_encode()
        code, values = codes.indices.to_numpy(), codes.dictionary
        begins = np.zeros(batch.num_rows, dtype=bool)
        for n in range(1, depth + 1):
            begins = begins | differs[f"w{n - 1}"]  # common prefix shorter than n
            if n not in states:
                continue
            state = states[n]
            there = batch.column(f"w{n - 1}").is_valid().to_numpy(zero_copy_only=False)  # suffixes of n words or more
            starts = np.flatnonzero(begins)
            if not len(starts) or starts[0]:
                starts = np.r_[0, starts]  # goes on from the batch before
            run = np.cumsum(begins) - (1 if begins[0] else 0)
            size = len(starts)
            counts = np.zeros(size, dtype=np.int64)
            np.add.at(counts, run, np.where(there, weight, 0))
            if n == depth:
                again = ~(begins | differs[RECORD])
                again[0] = False
                order = None
            else:
                order = np.lexsort((code, run))
                r, c = run[order], code[order]
                again = np.r_[False, (r[1:] == r[:-1]) & (c[1:] == c[:-1])]
            in_run = run if order is None else run[order]
            records = np.bincount(in_run, minlength=size) - np.bincount(in_run[again], minlength=size)
            exists = there[starts]
            ends = np.r_[starts[1:], batch.num_rows]
            words = [batch.column(f"w{k}") for k in range(n)]

            def of(i: int, words: list = words, starts: np.ndarray = starts) -> tuple:
                return tuple(w[int(starts[i])].as_py() for w in words)

            def some(i: int, n: int = n, order: np.ndarray | None = order, again: np.ndarray = again, starts: np.ndarray = starts, ends: np.ndarray = ends) -> list:
                a, b = int(starts[i]), int(ends[i])
                if order is None:
                    return [record[a].as_py(), record[b - 1].as_py()]
                return values.take(pa.array(code[order[a:b]][~again[a:b]])).to_pylist()

            # the first stretch may go on from before, the last may go on; those between are whole
            if begins[0]:
                state.end()
            if exists[0]:
                if begins[0]:
                    state.begin(of(0), last is None)
                state.add(int(counts[0]), int(records[0]), some(0))
            if size > 1:
                state.end()
                inner = np.flatnonzero(exists[1:-1]) + 1
                if len(inner):
                    take = pa.array(starts[inner])
                    columns = [words[k].take(take) if k < n else pa.nulls(len(inner), words[0].type) for k in range(depth)]
                    rest = [pa.array(np.full(len(inner), n), pa.int32()), pa.nulls(len(inner), schema.field("record").type), pa.array(counts[inner]), pa.array(records[inner].astype(np.int64)), pa.array(np.zeros(len(inner), dtype=bool))]
                    yield pa.RecordBatch.from_arrays([*columns, *rest], schema=schema)
                if exists[-1]:
                    state.begin(of(size - 1), False)
                    state.add(int(counts[-1]), int(records[-1]), some(size - 1))
        last = batch.slice(batch.num_rows - 1, 1)
        yield from written()
    for state in states.values():
        state.end(at_edge=True)
    yield from written()


def suffix_intervals(rows: DataFrame, words: list[Column], record: Column, weight: Column, unique: bool | list[str], lengths: list[int] | None = None, tasks: int | None = None) -> DataFrame:
    """Total weight and number of records of every n-gram of the suffixes ``words``, for all n up to their number or those in ``lengths``.

    A suffix ends at its first null word.  With ``unique``, rows equal in all
    columns of ``rows`` count once; a list names the columns that tell rows of
    equal words, record and weight apart.  ``record`` must not be null (filter before);
    null weights count as 0.  An empty table gives no rows.  Returns the words
    ``w0``, ... (null beyond the n-gram), ``n``, ``count``, ``records``.
    """
    depth = len(words)
    lengths = lengths or list(range(1, depth + 1))
    names = unique if isinstance(unique, list) else rows.columns if unique else []
    unique = unique is not False
    kept, there = [], F.lit(True)
    for k, w in enumerate(words):
        there = there & w.isNotNull()
        kept.append(F.when(there, w).alias(f"w{k}"))
    built = rows.select(*kept, record.alias(RECORD), F.coalesce(weight, F.lit(0)).cast("long").alias(WEIGHT), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).filter("w0 is not null")
    sortable = [c for c in built.columns if not isinstance(built.schema[c].dataType, (T.MapType, T.VariantType))]
    order = [F.col(c) for c in sortable if c != WEIGHT or unique]
    ordered = built.repartitionByRange(tasks or shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    fields = [T.StructField(f"w{k}", built.schema["w0"].dataType) for k in range(depth)]
    fields += [T.StructField("n", T.IntegerType()), T.StructField("record", built.schema[RECORD].dataType), T.StructField("count", T.LongType()), T.StructField("records", T.LongType()), T.StructField("open", T.BooleanType())]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    found = cut(ordered.mapInArrow(lambda batches: _intervals(batches, lengths, depth, unique, arrow), schema))
    gram = [f"w{k}" for k in range(depth)]
    whole = found.filter("not open").select(*gram, "n", "count", "records")
    parts = found.filter("open").groupBy(*gram, "n", "record").agg(F.sum("count").alias("count"), F.sum("records").alias("records"))
    parts = parts.groupBy(*gram, "n").agg(F.sum("count").alias("count"), F.sum(F.coalesce("records", F.lit(1))).alias("records"))
    return whole.unionByName(parts)


def interval_counts(rows: DataFrame, gram: Column, record: Column, weight: Column, unique: bool | list[str] = True, tasks: int | None = None) -> DataFrame:
    """Total weight and number of records of every distinct ``gram``: suffixes of one word; cases as of :func:`suffix_intervals`.

    Null grams are left out.  Returns ``gram``, ``count``, ``records``.
    """
    return suffix_intervals(rows, [gram], record, weight, unique, tasks=tasks).select(F.col("w0").alias("gram"), "count", "records")


def all_ngram_counts(df: DataFrame, record: str, tokens: str, depth: int, lengths: list[int] | None = None) -> DataFrame:
    """Occurrences and records of every run of up to ``depth`` elements of the array ``tokens``, from one suffix array.

    Rows equal in all columns count once.  Null and empty arrays and rows without
    a record yield nothing; an n-gram with a null element is left out; the empty
    string is an element like any other.  Returns ``gram`` array<string>, ``n``,
    ``count``, ``records``.
    """
    t = F.col(f"`{tokens}`")
    held = df.filter(t.isNotNull() & F.col(f"`{record}`").isNotNull() & (F.size(t) > 0)).distinct()
    count = F.size(t)
    shifted = F.arrays_zip(*[F.slice(t, k + 1, F.greatest(count - k, F.lit(0))).alias(f"s{k}") for k in range(depth)])  # shorter ones filled up with nulls
    suffixes = held.select(F.col(f"`{record}`").alias("r"), F.inline(shifted))
    found = suffix_intervals(suffixes, [F.col(f"s{k}") for k in range(depth)], F.col("r"), F.lit(1), unique=False, lengths=lengths)
    return found.select(F.slice(F.array(*[f"w{k}" for k in range(depth)]), F.lit(1), F.col("n")).alias("gram"), "n", "count", "records")


def ngram_counts(df: DataFrame, record: str, tokens: str, n: int) -> DataFrame:
    """The n-grams of one length; cases as of :func:`all_ngram_counts`.  Returns ``gram``, ``count``, ``records``."""
    return all_ngram_counts(df, record, tokens, n, [n]).select("gram", "count", "records")


def term_frequencies(unigrams: DataFrame, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """Every distinct token with ``count``, ``records`` and ``mark``.

    ``mark`` is 'rare' in fewer than ``rare_below`` records, 'common' in more
    than ``common_share`` of all records of the table, else null (where both
    hold, in tiny tables, 'rare').  Rows equal in all columns count once; rows
    with a null token or record or a count that is null or below 1 don't count;
    the empty string is a token.
    """
    total = record_count(unigrams)
    others = [c for c in unigrams.columns if c not in ("token", "nc:id", "count")]
    counts = interval_counts(countable(unigrams), F.col("token"), F.col("`nc:id`"), F.col("count"), others)
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(total) * F.lit(common_share), "common")
    return counts.select(F.col("gram").alias("token"), "count", "records", mark.alias("mark"))
