"""Problem 8: byte-level BPE of a whole corpus by a lazily determinised transducer.

The merges of a public vocabulary are compiled into a transducer that reads
bytes and writes token ids:

* Two neighbouring tokens are *stable* when no merge could have crossed their
  border.  A segmentation is the one that BPE gives exactly when every piece is
  a token and every border is stable, so a path through the transducer is a
  walk over tokens with stable borders and needs no ordering of merges.
* States are determinised when first met: whether a border is stable, and what
  a whole stretch of bytes emits, is worked out once per worker and kept (the
  tables are emptied when full; nothing depends on what they hold).
* A token is written as soon as a fixed number of tokens has been read beyond it,
  so the lookahead is bounded.  A vocabulary can be such that a border hangs on
  bytes still further on (a chain of merges each of which comes before the one to
  its left); then the walk would have to step back beyond what it has written.
  That is noticed, and the stretch is walked again holding all its tokens.  What
  comes out of either walk has stable borders throughout and so is exact.

The stretches between which no merge happens are cut by column-wise arithmetic
over the byte buffer of a whole Arrow batch: a UTF-8 state machine gives the
class of every character (letter, number, blank, white space, other), and the
borders follow from neighbouring classes.  Distinct stretches of a batch are
found by Arrow's hashing and only those go through the transducer.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MEMO_ENTRIES = 1 << 18
#: Longer stretches go through in one pass but are not kept.
MEMO_BYTES = 64

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4
#: White space of Unicode besides the blank; fixed values.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: English endings that are a stretch of their own after an apostrophe; fixed values.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Crossed(Exception):
    """A walk would have to step back beyond what it has written."""


class Transducer:
    """Byte strings to ids of one vocabulary; grows as it is used."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _printable_bytes()
        self.id_of = {bytes(byte_of[c] for c in shown): i for shown, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> (left, right, rank of their merge)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank[a, b] = rank
            self.parts.setdefault(model["vocab"][left + right], (a, b, rank))
        self.longest = max(map(len, self.id_of))
        self.reach: dict[bytes, int] = {}  # first two bytes -> length of the longest token that begins with them
        for token in self.id_of:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))
        self.borders: dict[tuple[int, int], bool] = {}
        self.written: dict[bytes, tuple[int, ...]] = {}
        self.whole: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while ``token`` is being built, each with the rank of the merge that swallows it."""
        steps: list[tuple[int, float]] = [(token, float("inf"))]
        while (made := self.parts.get(steps[-1][0])) is not None:
            steps.append((made[side], made[2]))
        return steps[::-1]

    def stable(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between ``a`` and ``b``."""
        known = self.borders.get((a, b))
        if known is None:
            left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                crossing = self.rank.get((x, y))
                if crossing is not None and crossing < x_ends and crossing <= y_ends:
                    known = False
                    break
                if x_ends == y_ends == float("inf"):
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.borders) >= 4 * MEMO_ENTRIES:
                self.borders.clear()
            self.borders[a, b] = known
        return known

    def _is_whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` come out as this one token."""
        known = self.whole.get(token)
        if known is None:
            made = self.parts.get(token)
            known = self.whole[token] = made is None or (self.stable_until(made[0], made[1], made[2]) and self._is_whole(made[0]) and self._is_whole(made[1]))
        return known

    def stable_until(self, a: int, b: int, rank: int) -> bool:
        """Whether the border between ``a`` and ``b`` first falls to the merge of both."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            crossing = self.rank.get((x, y))
            if crossing is not None and crossing < x_ends and crossing <= y_ends:
                return (x, y) == (a, b) and crossing == rank
            if x_ends == y_ends == float("inf"):
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def walk(self, data: bytes, hold: int | None = None) -> Iterator[int]:
        """Ids of a stretch, written as soon as ``hold`` tokens are read beyond them (all at the end if it is 0).

        The walk takes the longest token with a stable border to the one before
        and steps back when none fits.  ``Crossed`` is raised where it would have
        to step back beyond a token that it has written.
        """
        hold = 2 * self.longest if hold is None else hold
        n, pending, id_of, stable, reach = len(data), [], self.id_of, self.stable, self.reach
        pos, written = 0, False
        size = min(reach.get(data[:2], 1), n)
        while pos < n:
            before = pending[-1][0] if pending else None
            step = None
            while size:
                token = id_of.get(data[pos : pos + size])
                if token is not None and self._is_whole(token) and (before is None or stable(before, token)):
                    step = (token, size)
                    break
                size -= 1
            if step is not None:
                pending.append(step)
                pos += step[1]
                size = min(reach.get(data[pos : pos + 2], 1), n - pos)
                if hold and len(pending) > hold:
                    written = True
                    for token, _ in pending[: hold // 2]:
                        yield token
                    del pending[: hold // 2]
            else:
                token, used = pending.pop()
                if written and not pending:  # the token before it is written already
                    raise Crossed
                pos -= used
                size = used - 1
        for token, _ in pending:
            yield token

    def ids(self, data: bytes) -> tuple[int, ...]:
        """Ids of a stretch."""
        try:
            return tuple(self.walk(data))
        except Crossed:
            return tuple(self.walk(data, hold=0))

    def __call__(self, data: bytes) -> tuple[int, ...]:
        ids = self.written.get(data)
        if ids is None:
            token = self.id_of.get(data)
            ids = (token,) if token is not None and self._is_whole(token) else self.ids(data)
            if len(data) <= MEMO_BYTES:
                if len(self.written) >= MEMO_ENTRIES:
                    self.written.clear()
                self.written[data] = ids
        return ids


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One per worker and vocabulary."""
    return Transducer(path)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point; the last entry is a border between documents."""
    of = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    classes[WHITE_SPACE] = SPACE
    classes[32] = BLANK
    return classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of every byte: that of the character it is part of."""
    classes = character_classes()
    out = classes[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        kind = classes[code]
        out[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def stretch_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which the stretches of all documents begin.

    ``starts`` are the offsets of the documents in ``data``.  A stretch is an
    apostrophe ending, a run of letters, of numbers or of other characters,
    each with one blank before it, or white space; the last white-space
    character before anything else stands apart from those before it.
    """
    n = len(data)
    kind = byte_classes(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[starts] = True
    begins[n] = True
    white = kind >= BLANK
    group = np.where(white, SPACE, kind)
    cut = np.empty(n + 1, dtype=bool)
    cut[0] = cut[n] = True
    np.not_equal(group[1:], group[:-1], out=cut[1:n])
    cut |= begins
    # the last character of white space before something else
    ends = np.flatnonzero(cut[1:]) + 1  # end of each run
    ends = ends[white[ends - 1]]
    inner = ends[~begins[ends]]
    last = inner - 1
    wide = last[(data[last] & 0xC0) == 0x80]  # white space of several bytes
    if len(wide):
        moved = last.copy()
        for _ in range(3):
            tail = (data[moved] & 0xC0) == 0x80
            moved[tail] -= 1
        last = moved
    cut[last] = True
    blank = last[kind[last] == BLANK]
    joined = np.zeros(n + 1, dtype=bool)
    joined[blank + 1] = True
    cut[blank + 1] = False
    # apostrophe endings: a run of one apostrophe without a blank before it, then letters
    apostrophe = np.flatnonzero((data[: n - 1] == 39) & cut[: n - 1] & cut[1:n] & (kind[1:n] == LETTER) & ~begins[1:n])
    if len(apostrophe):
        apostrophe = apostrophe[~joined[apostrophe]]
        c1 = data[apostrophe + 1]
        second = apostrophe + 2
        in_text = (second < n) & ~begins[np.minimum(second, n)]
        c2 = np.where(in_text, data[np.minimum(second, n - 1)], 0)
        for ending in ENDINGS:
            e = ending.encode()
            hit = c1 == e[0]
            if len(e) == 2:
                hit &= c2 == e[1]
            at = apostrophe[hit]
            cut[at + 1] = False
            cut[at + 1 + len(e)] = True
            apostrophe, c1, c2 = apostrophe[~hit], c1[~hit], c2[~hit]
    return np.flatnonzero(cut[:n])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the offsets of its rows in them (one more than rows)."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def encode_column(column: pa.Array, path: str) -> pa.ListArray:
    """Ids of every text of a column; an empty list for a null or empty text."""
    rows = len(column)
    data, offsets = _texts(column)
    if not len(data):
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.int32()))
    starts = stretch_starts(data, offsets[:-1][offsets[:-1] < len(data)])
    bounds = np.r_[starts, len(data)].astype(np.int32)
    stretches = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = stretches.dictionary_encode()
    read = transducer(path)
    ids = [read(s) for s in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for t in ids for i in t), np.int32, int(size.sum()))
    index = coded.indices.to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    n_each = size[index]
    until = np.cumsum(n_each)
    take = np.repeat(begin[index] - (until - n_each), n_each) + np.arange(until[-1])
    row_first = np.searchsorted(starts, offsets)  # first stretch of each row
    row_ids = np.r_[0, until][row_first].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(row_ids), pa.array(flat[take]))


#: Bytes of text that are encoded at once; longer texts go alone.
SLICE_BYTES = 1 << 22


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the column ``text`` replaced by ``ids`` array<int>.

    Special tokens are never written; strings that look like them are ordinary
    text.  A null or empty text gives an empty list.  Texts of any length are
    read whole.  No shuffle: each input partition is encoded where it is read.
    """
    others = [c for c in df.columns if c not in (text, ids)]
    df = df.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").cast("string").alias(text))
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                columns = [part.column(c) for c in others] + [encode_column(part.column(text), path)]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, ids])

    return df.mapInArrow(run, schema)


class Utf8Reader:
    """Incremental UTF-8 decoding: bytes in, whole characters out.

    Holds back an unfinished character until its last byte comes; a broken
    sequence comes out as U+FFFD and reading goes on after it.
    """

    def __init__(self) -> None:
        self.rest = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.rest + data
        keep = 0
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte >= 0xC0:
                    need = 2 + (byte >= 0xE0) + (byte >= 0xF0)
                    keep = back if back < need else 0
                    break
                if byte < 0x80:
                    break
        self.rest = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


def decode_ids(ids: list[int] | None, path: str = DEFAULT_VOCABULARY) -> str:
    """Text of a list of ids, token by token through the UTF-8 state machine."""
    of, reader = transducer(path).bytes_of, Utf8Reader()
    return "".join([*(reader.feed(of[i]) for i in (ids if ids is not None else [])), reader.feed(b"", final=True)])


def decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``ids`` replaced by the ``text`` they stand for; an empty or null list gives ''."""
    others = [c for c in df.columns if c not in (text, ids)]
    df = df.select(*[f"`{c}`" for c in others], f"`{ids}`")
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_ids(x, path) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), texts], names=[*others, text])

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its number of ids (bigint; 0 for null or empty): the lists never leave the worker."""
    others = [c for c in df.columns if c not in (text, tokens)]
    df = df.select(*[f"`{c}`" for c in others], F.col(f"`{text}`").cast("string").alias(text))
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                sizes = pc.cast(pc.list_value_length(encode_column(part.column(text), path)), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), sizes], names=[*others, tokens])

    return df.mapInArrow(run, schema)
