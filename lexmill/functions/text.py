"""Column functions on text and identifiers: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, and what the document tokenizer takes for a word or a run of signs; fixed values.
NOT_A_LETTER = r"[^\p{L}]"
WORD_OR_SIGNS = r"[\p{L}\p{N}_^]+|[^\p{L}\p{N}_\s\p{Z}]+"
DATE_LIKE = r"[0-9]{3,4}-[0-1]?[0-9]-[0-3]?[0-9]"


def as_column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """Text cut at every character that isn't a letter; empty strings stay, '' gives [''], null gives null."""
    return F.split(as_column(text), NOT_A_LETTER, -1)


def document_words(text: Column | str) -> Column:
    """Words (letters, numbers, _ and ^) and runs of signs."""
    return F.regexp_extract_all(as_column(text), F.lit(WORD_OR_SIGNS), F.lit(0))


def document_length(tokens: Column | str) -> Column:
    """Number of tokens, empty ones included; null for null."""
    t = as_column(tokens)
    return F.when(t.isNotNull(), F.size(t).cast("long"))


def word_names(n: int, first: int = 0) -> list[str]:
    return [f"word{i}" for i in range(first, first + n)]


def ngrams(tokens: Column | str, n: int) -> Column:
    """Every run of ``n`` tokens as a struct word0..word{n-1}; an empty array for shorter documents, null for null."""
    t = as_column(tokens)
    count = F.greatest(F.size(t) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(t, i + 1, count).alias(w) for i, w in enumerate(word_names(n))])


def chunk_index(position: Column, total: Column, size: int) -> Column:
    """Chunk of a token: chunks have ``size`` tokens, the first and last share what is over evenly.

    What is over is n mod size, plus a whole size when it is less than two
    thirds of one; documents shorter than that are one chunk.
    """
    over = total % size
    over = F.when(over * 3 < 2 * size, over + size).otherwise(over)
    half = F.floor(over / 2)
    middle = F.floor((total - over) / size) + 1
    return F.when(position < half, F.lit(0)).otherwise(F.least(middle, F.floor((position - half) / size) + 1)).cast("long")


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Number of leading characters that two strings share."""
    a, b = as_column(a), as_column(b)
    shorter = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), shorter), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same).cast("long")


def extract_year(text: Column | str) -> Column:
    """First run of four digits as a number, null without one."""
    return F.regexp_extract(as_column(text), r"([0-9]{4})", 1).try_cast("smallint")


def id_from_path(path: Column | str) -> Column:
    """File name without folder, document ending and compression ending."""
    name = F.regexp_extract(as_column(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(\.(?:txt|md|rtf|xml))?(\.(?:gz|lz4|bz2))?$", "")


def bits_to_longs(packed: Column, words: int) -> Column:
    """Packed bits as ``words`` 64-bit numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.conv(F.hex(F.substring(packed, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
