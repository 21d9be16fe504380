"""Fixed-size document vectors by stable random projection, their sign bits, and close pairs of signatures.

Formula (ours; numeric equality with other packages isn't claimed): a token
has ``dims`` signs, the bits of SHA-1(token), SHA-1(token + "1"), ... in order,
1 as +1 and 0 as -1.  A document's vector is the sum of its tokens' signs
weighted by max(0, ln(count / total * 100000)).  Empty documents have
sqrt(dims) everywhere.  Bits are packed from the most significant on, 1 for a
positive element.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import bits_to_longs, hamming, tokenize
from lexmill.session import cut

DIMS = 1280
SCALE = 1e5
#: Token signs a worker keeps (one byte a sign).
KEPT_TOKENS = 20_000
#: Documents projected at once.
SLICE = 64


@lru_cache(maxsize=KEPT_TOKENS)
def token_signs(token: str, dims: int) -> np.ndarray:
    """+1 and -1 of a token, always the same."""
    digests = b"".join(hashlib.sha1((token + (str(i) if i else "")).encode()).digest() for i in range(-(-dims // 160)))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8))[:dims]
    return (bits.astype(np.int8) << 1) - 1


def project(documents: list[list[str] | None], dims: int = DIMS) -> np.ndarray:
    """Vectors of some documents, a row each, by one matrix product; empty strings don't count."""
    place: dict[str, int] = {}
    at, columns, weights = [], [], []
    empty = []
    for i, tokens in enumerate(documents):
        counts = Counter(t for t in tokens or [] if t)
        if not counts:
            empty.append(i)
            continue
        total = sum(counts.values())
        for token, n in counts.items():
            weight = math.log(n / total * SCALE)
            if weight > 0:
                at.append(i)
                columns.append(place.setdefault(token, len(place)))
                weights.append(weight)
    if place:
        signs = np.stack([token_signs(t, dims) for t in place]).astype(np.float64)
        w = np.zeros((len(documents), len(place)))
        w[at, columns] = weights
        out = (w @ signs).astype(np.float32)
    else:
        out = np.zeros((len(documents), dims), dtype=np.float32)
    out[empty] = math.sqrt(dims)
    return out


def random_projection(corpus: DataFrame, dims: int = DIMS) -> DataFrame:
    """``nc:id``, ``SRP`` array<float>, ``SRP_bits`` binary of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # vectors are far larger than texts
                part = batch.slice(at, SLICE)
                rows = project(part.column("t").to_pylist(), dims)
                offsets = pa.array(np.arange(0, rows.size + 1, dims, dtype=np.int32))
                bits = pa.array([np.packbits(v > 0).tobytes() for v in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), bits], names=["nc:id", "SRP", "SRP_bits"])

    return corpus.select("`nc:id`", tokenize("text").alias("t")).mapInArrow(run, "`nc:id` long, SRP array<float>, SRP_bits binary")


def write_vectors(corpus: DataFrame, path: str, dims: int = DIMS) -> None:
    """A job: ``nc:id``, vector and packed sign bits of every document as one Parquet table; an old one is replaced."""
    random_projection(corpus, dims).write.mode("overwrite").option("compression", "zstd").parquet(path)


def nearest_pairs(pairs: DataFrame, about: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` pairs of least distance (of equals the smaller ids) with what a catalog says of both: a report.

    ``about`` has ``a`` (the id) and columns that end in ``_a``; they come a
    second time for b, ending in ``_b``.  The pairs are cut to ``k`` before they
    meet the catalog.
    """
    top = pairs.orderBy("distance", "a", "b").limit(k)
    other = about.toDF(*[c[:-1] + "b" if c.endswith("_a") else "b" for c in about.columns])
    return about.join(F.broadcast(top), "a").join(other, "b").select("a", "b", "distance", *[c for c in about.columns if c != "a"], *[c for c in other.columns if c != "b"])


def sign_words(vector: Column | str, dims: int) -> Column:
    """Signs of an array of numbers as 64-bit numbers, the first element in the highest bit (JVM only)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    words = -(-dims // 64)
    bit = lambda w: F.aggregate(F.slice(v, w * 64 + 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), bit)


def packed_words(packed: Column | str, dims: int) -> Column:
    p = F.col(packed) if isinstance(packed, str) else packed
    return bits_to_longs(p, dims // 64)


def signature_classes(df: DataFrame, id: str, words: str) -> DataFrame:
    """``id``, ``class``: the smallest id with the same signature, by an aggregate and a join; null signatures are left out."""
    held = df.filter(F.col(words).isNotNull())
    first = held.groupBy(F.col(words).alias("__words")).agg(F.min(id).alias("class"))
    return held.join(first, F.col(words) == F.col("__words")).select(id, "class")


def choose_bands(rows: int, dims: int, most: int) -> tuple[int, int]:
    """Bands, and flips in a band, that meet the fewest candidates.

    Signatures within ``most`` bits differ in ``most // bands`` bits or fewer in
    one of the bands.  Many bands are narrow and meet by chance, few have to be
    looked up with bits flipped; what both cost follows from the number of rows.
    """

    def cost(bands: int) -> float:
        width, flips = dims // bands, most // bands
        looked = bands * sum(math.comb(width, k) for k in range(flips + 1))
        return rows * looked + rows * rows * looked / 2.0**width

    fit = [m for m in range(1, most + 2) if m == most + 1 or dims // m < 63 and sum(math.comb(-(-dims // m), k) for k in range(most // m + 1)) <= MOST_FLIPPED]
    bands = min(fit, key=lambda m: (cost(m), m))
    return bands, most // bands


#: Flipped forms of a band that are looked up at most.
MOST_FLIPPED = 4096


def close_pairs(df: DataFrame, id: str, words: str, dims: int, most: int) -> DataFrame:
    """``a``, ``b`` (a < b), ``distance``: pairs of classes whose signatures differ in at most ``most`` bits.

    A class is named by its smallest id and stands for all copies of its
    signature (see :func:`signature_classes`), so copies are neither collected
    nor paired.  Signatures are cut into bands (see :func:`choose_bands`) of
    which one at least must nearly agree: pairs are found by an equi-join on
    (band, its bits), one side with up to so many bits flipped, and none is missed.
    """
    signatures = cut(df.filter(F.col(words).isNotNull()).groupBy(F.col(words).alias("words")).agg(F.min(id).alias("id")))
    bands, flips = choose_bands(signatures.count(), dims, most)
    at = [round(i * dims / bands) for i in range(bands + 1)]
    bits = F.concat_ws("", F.transform("words", lambda x: F.lpad(F.conv(x.cast("string"), 10, 2), 64, "0")))
    cuts = F.array(*[F.substring("shown", lo + 1, hi - lo) for lo, hi in zip(at, at[1:])])
    keys = signatures.withColumn("shown", bits).select("id", "words", F.posexplode(cuts).alias("band", "bits"))
    left, right = keys.withColumnsRenamed({"id": "a", "words": "wa"}), keys.withColumnsRenamed({"id": "b", "words": "wb"})
    if flips:
        width = max(hi - lo for lo, hi in zip(at, at[1:]))
        masks = sorted(sum(1 << i for i in on) for k in range(flips + 1) for on in itertools.combinations(range(width), k))
        number = F.conv("bits", 2, 10).cast("long")
        left = left.withColumn("bits", number)
        flipped = F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), lambda m: number.bitwiseXOR(m))
        right = right.select("b", "wb", "band", F.explode(flipped).alias("bits"))
    met = left.join(right, ["band", "bits"]).filter("a < b").withColumn("distance", hamming(F.col("wa"), F.col("wb")).cast("long"))
    return met.filter(F.col("distance") <= most).select("a", "b", "distance").distinct()
