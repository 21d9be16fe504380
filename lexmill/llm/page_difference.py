"""Problem 5, pages with a URL: what a page shares with its nearest page is template.

Pages of one host are put in order by path.  Each is paired with that of its two
neighbours whose path it shares more leading segments with, and then more
leading characters (of equals, the one before it).  The lines of both are aligned
by a longest common subsequence and the shared lines are deleted, so that
navigation, headers, footers and other lines of the template go and the page's
own lines stay.

Hosts may be of any size: all pages are ranked by (host, path, id) in one
range-partitioned sort, cut into blocks of ``BLOCK`` ranks whichever host they
are of, and the pages at a block's ends go to the neighbouring block too.  A task
reads its blocks as a stream and holds three pages.

The subsequence is found by bit-parallel arithmetic: a row of the table is one
integer with a bit for every line of the other page, so pages of many thousand
lines are compared whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.features import global_rank
from lexmill.session import shuffle_width

BLOCK = 512


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of the lines of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _aligned(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*range(head), *(head + i for i in inner), *range(len(a) - tail, len(a))]


def _aligned(a: list[str], b: list[str]) -> list[int]:
    width = len(b)
    if not a or not width:
        return []
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    mask = (1 << width) - 1
    row, rows = mask, []
    for line in a:  # a bit is 0 where one more line of b makes the common subsequence longer
        met = row & places.get(line, 0)
        row = (row + met | row - met) & mask
        rows.append(row)
    out, i, j = [], len(a), width
    while i and j:
        bit = 1 << j - 1
        if rows[i - 1] & bit:
            j -= 1
        elif i > 1 and not rows[i - 2] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def nearness(a: str, b: str) -> tuple[int, int]:
    """Leading segments, and leading characters, that two paths share."""
    x, y = a.split("/"), b.split("/")
    segments = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    characters = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return segments, characters


def _difference(page: tuple, before: tuple | None, after: tuple | None) -> tuple:
    """(id, id of the pair, lines, shared lines, own text) of a page; pages are (id, host, path, text)."""
    key, host, path, text = page
    near = [p for p in (before, after) if p is not None and host is not None and p[1] == host and p[3] is not None]
    if text is None:
        return key, None, 0, 0, None
    lines = text.split("\n")
    if not near:
        return key, None, len(lines), 0, text
    pair = max(near, key=lambda p: nearness(path, p[2]))  # the first of equals
    bare = lambda t: [x.rstrip("\r") for x in t.split("\n")]
    shared = set(shared_lines(bare(text), bare(pair[3])))
    return key, pair[0], len(lines), len(shared), "\n".join(x for i, x in enumerate(lines) if i not in shared)


def page_difference(pages: DataFrame, id: str, host: str, path: str, text: str) -> DataFrame:
    """``page_id``, ``pair_id``, ``lines``, ``shared``, ``own`` of every row of ``pages``.

    ``own`` is the text less the lines it shares with its pair.  A page without a
    host, or alone on it, or with neighbours of null text only, has no pair and
    stays as it is; a null path counts as ''; a null text stays null and is no
    pair for others.  Line ends \\r\\n and \\n are alike.  Repeated rows are pages
    of their own, each other's pairs where nothing is nearer.  Other columns are
    left out, so none clashes.  An empty table gives no rows.
    """
    column = lambda c: F.col(f"`{c}`")
    held = pages.select(column(id).alias("id"), column(host).cast("string").alias("host"), F.coalesce(column(path).cast("string"), F.lit("")).alias("path"), column(text).alias("text"))
    ranked = global_rank(held, [F.asc("host"), F.asc("path"), F.asc("id"), F.asc(F.xxhash64("text"))], "rank")
    block, place = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    goals = F.when((place == 0) & (F.col("rank") > 0), F.array(block, block - 1)).when(place == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    placed = ranked.select("*", F.explode(goals).alias("block")).withColumn("guest", F.col("block") != block)
    ordered = placed.repartition(shuffle_width(pages.sparkSession), "block").sortWithinPartitions("block", "rank")
    fields = [("page_id", held.schema["id"].dataType), ("pair_id", held.schema["id"].dataType)]
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in fields) + ", lines long, shared long, own string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: deque = deque(maxlen=3)  # (block, guest, page)

        def middle() -> list[tuple]:
            (b0, _, before), (b1, guest, page), (b2, _, after) = near
            return [] if page is None or guest else [_difference(page, before if b0 == b1 else None, after if b2 == b1 else None)]

        none = (None, True, None)
        near.extend([none, none, none])
        for batch in batches:
            rows = []
            kind = batch.column("id").type
            for r in zip(*(batch.column(c).to_pylist() for c in ("block", "guest", "id", "host", "path", "text"))):
                near.append((r[0], r[1], tuple(r[2:])))
                rows += middle()
            if rows:
                yield _batch(rows, kind)
        near.append(none)
        if near[1][2] is not None and (rows := middle()):
            yield _batch(rows, kind)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [kind, kind, pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "pair_id", "lines", "shared", "own"])

    return ordered.select("block", "guest", "id", "host", "path", "text").mapInArrow(run, schema)
