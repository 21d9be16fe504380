"""Document-level features: tokens, lengths, n-gram counts, vocabulary, encoded counts.

A feature table has ``nc:id`` and one row per document or per (document, words).
Where every document is one row (``one_row_each``) its n-grams are counted where
it is read and nothing is shuffled.  Else texts are spread by ``nc:id`` once,
before tokens are exploded: whole texts are far smaller than their n-grams, and
every count by document finds its rows in place, so neither n-grams nor their
counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import as_column, chunk_index, document_length, ngrams, tokenize, word_names
from lexmill.session import cut, shuffle_width

ID = "nc:id"
_ID = f"`{ID}`"
VOCABULARY_CAP = 1_000_000
#: A vocabulary is broadcast up to this many characters of tokens.
BROADCAST_CHARS = 64_000_000

GRAMS = {"unigrams": 1, "bigrams": 2, "trigrams": 3, "quadgrams": 4, "quintgrams": 5}


def texts(df: DataFrame, id: str, text: str) -> DataFrame:
    """The corpus form of a table: ``nc:id`` and ``text``."""
    return df.select(F.col(f"`{id}`").cast("long").alias(ID), F.col(f"`{text}`").alias("text"))


def tokenization(corpus: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``nc:id``, ``tokenization``; another tokenizer may be given as a column over ``text``."""
    return corpus.select(_ID, (tokenize("text") if tokens is None else tokens).alias("tokenization"))


def document_lengths(corpus: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``nc:id``, ``nwords``: tokens of each document, empty ones included."""
    return corpus.select(_ID, document_length(tokenize("text") if tokens is None else tokens).alias("nwords"))


#: Tokens whose n-grams are counted at once; a longer document goes alone.
SLICE_TOKENS = 1 << 20


def _counted_in_place(batches: Iterator[pa.RecordBatch], n: int, ends: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each row of (id, tokens), column-wise over many rows."""
    words = word_names(n)
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
        edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)]
        for a, b in zip(edges[:-1], edges[1:]):
            rows = batch.slice(a, b - a)
            flat = pc.list_flatten(rows.column(1))
            row = pc.list_parent_indices(rows.column(1)).to_numpy()
            starts = np.arange(max(len(flat) - n + 1, 0))
            whole = starts[row[starts] == row[starts + n - 1]] if len(starts) else starts  # within one document
            if not len(whole):
                continue
            columns = {w: flat.take(pa.array(whole + k)) for k, w in enumerate(words)}
            grams = pa.table({"row": pa.array(row[whole]), **columns})
            for w in words[:-1] if ends else []:
                grams = grams.filter(pc.invert(pc.is_in(grams[w], pa.array(ends))))
            found = grams.group_by(["row", *words]).aggregate([([], "count_all")])
            ids = rows.column(0).take(found["row"].combine_chunks())
            yield from pa.table({ID: ids, **{w: found[w] for w in words}, "count": found["count_all"]}).combine_chunks().to_batches()


def ngram_counts(corpus: DataFrame, n: int, end_tokens: list[str] | None = None, one_row_each: bool = False, tokens: Column | None = None) -> DataFrame:
    """``nc:id``, ``word0``.., ``count``: runs of ``n`` tokens per document.

    Runs never cross documents; a document shorter than ``n`` has none.  With
    ``end_tokens`` no run goes on past one of these tokens.  ``one_row_each``
    says that no ``nc:id`` is repeated (where it is, each row is counted by
    itself); another tokenizer may be given as ``tokens``, a column over ``text``.
    """
    tokens = tokenize("text") if tokens is None else tokens
    words = word_names(n)
    if one_row_each:
        schema = f"`{ID}` long, " + ", ".join(f"{w} string" for w in words) + ", count long"
        ends = end_tokens if end_tokens and n > 1 else []
        return corpus.select(_ID, tokens.alias("t")).mapInArrow(lambda batches: _counted_in_place(batches, n, ends), schema)
    placed = corpus.repartition(F.col(_ID))
    grams = placed.select(_ID, F.inline(ngrams(tokens, n)))
    if end_tokens and n > 1:
        grams = grams.filter(~F.greatest(*[F.col(w).isin(end_tokens).cast("int") for w in words[:-1]], F.lit(0)).cast("boolean"))
    return grams.groupBy(_ID, *words).agg(F.count("*").alias("count"))


def nested_ngrams(corpus: DataFrame, n: int, name: str) -> DataFrame:
    """``nc:id`` and an array of structs sorted by words; documents without n-grams keep an empty array."""
    flat = ngram_counts(corpus, n)
    held = flat.groupBy(_ID).agg(F.array_sort(F.collect_list(F.struct(*word_names(n), "count"))).alias(name))
    empty = F.from_json(F.lit("[]"), held.schema[name].dataType.simpleString())
    return corpus.select(_ID).join(held, ID, "left").select(_ID, F.coalesce(name, empty).alias(name))


def explode_nested(nested: DataFrame, name: str) -> DataFrame:
    """A nested feature as flat rows again."""
    return nested.select(_ID, F.inline(name))


def chunked_counts(corpus: DataFrame, size: int, chunk_name: str = "chunk") -> DataFrame:
    """``nc:id``, chunk, ``token``, ``count``: word counts of stretches of about ``size`` tokens."""
    placed = corpus.repartition(F.col(_ID)).select(_ID, tokenize("text").alias("t"))
    at = placed.select(_ID, F.size("t").alias("total"), F.posexplode("t").alias("pos", "token"))
    return at.groupBy(_ID, chunk_index(F.col("pos"), F.col("total"), size).alias(chunk_name), "token").agg(F.count("*").alias("count"))


def global_rank(df: DataFrame, order: list[Column], name: str, tasks: int | None = None) -> DataFrame:
    """``df`` with its 0-based place in ``order`` (which must leave no ties) without sorting in one task.

    Rows are range-partitioned and sorted in place; a row's number is the number
    of rows in the partitions before its own plus its place in it.  One number
    per partition reaches the driver.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(tasks or shuffle_width(spark), *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    ahead = F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<bigint>")
    return ordered.withColumn(name, F.element_at(ahead, (part + 1).cast("int")) + place).drop("__at")


def vocabulary(corpus: DataFrame, cap: int | None = VOCABULARY_CAP, tokens: Column | None = None) -> DataFrame:
    """``token``, ``count``, ``wordid``: tokens by falling count, of equals the smaller first; the first ``cap`` of them."""
    counts = corpus.select(F.explode(tokenize("text") if tokens is None else tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    ranked = global_rank(counts, [F.desc("count"), F.asc("token")], "wordid")
    return ranked if cap is None else ranked.filter(F.col("wordid") < cap)


def encode(grams: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """Counts with word ids in place of words; a word outside the vocabulary gives a null id, its row stays.

    Unigrams come out as ``nc:id``, ``wordid``, ``count``, others with ``word1``
    .. ``word{n}``.  The vocabulary is broadcast once for all words when its
    tokens are few enough (counted, not guessed); else it is joined by shuffle.
    """
    ids = vocab.select("token", "wordid")
    chars = ids.agg(F.coalesce(F.sum(F.length("token") + 16), F.lit(0))).first()[0]
    held = F.broadcast(ids) if chars <= BROADCAST_CHARS else ids
    out = grams
    names = ["wordid"] if n == 1 else word_names(n, 1)
    for word, name in zip(word_names(n), names):
        out = out.join(held.select(F.col("token").alias(word), F.col("wordid").alias(f"__{name}")), word, "left")
    return out.select(_ID, *[F.col(f"__{x}").alias(x) for x in names], "count")


def top_ngrams(corpus: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` most frequent n-grams of the corpus, of equals the smaller words first."""
    words = word_names(n)
    counts = corpus.select(F.inline(ngrams(tokenize("text"), n))).groupBy(*words).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), *words).limit(k)


def word_share(corpus: DataFrame, word: str) -> DataFrame:
    """``nc:id``, ``total``, ``hits``, ``share`` of one word in each document: no rows are exploded."""
    t = tokenize("text")
    sized = corpus.filter("text is not null").select(_ID, F.size(t).cast("long").alias("total"), F.size(F.filter(t, lambda x: x == word)).cast("long").alias("hits"))
    return sized.withColumn("share", F.col("hits") / F.col("total"))


def id_map(df: DataFrame, id: str, order: list[Column]) -> DataFrame:
    """``@id`` and its dense number ``nc:id`` in an explicit order."""
    return global_rank(df.select(as_column(id).cast("string").alias("@id"), *[o.alias(f"__o{i}") for i, o in enumerate(order)]), [F.col(f"__o{i}") for i in range(len(order))], ID).select("@id", _ID)
