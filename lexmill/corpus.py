"""The corpus: texts and catalog under a root folder, features by name.

Features are lazy DataFrames.  Those named in ``cache`` are stored as Parquet
under the root when first asked for, and read from there afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import document_words, tokenize
from lexmill.operators import catalog as cat
from lexmill.operators import features, vectors
from lexmill.operators.features import ID
from lexmill.sources import catalogs, files, sinks
from lexmill.sources import texts as sources

Feature = Callable[["Corpus"], DataFrame]

REGISTRY: dict[str, Feature] = {
    "text": lambda c: c.texts(),
    "tokenization": lambda c: features.tokenization(c.texts(), c.tokens()),
    "document_lengths": lambda c: features.document_lengths(c.texts(), c.tokens()),
    **{name: (lambda c, n=n: features.ngram_counts(c.texts(), n, tokens=c.tokens())) for name, n in features.GRAMS.items()},
    "total_wordcounts": lambda c: features.vocabulary(c.texts(), tokens=c.tokens()),
    "encoded_unigrams": lambda c: features.encode(c.feature("unigrams"), c.feature("total_wordcounts"), 1),
    "encoded_bigrams": lambda c: features.encode(c.feature("bigrams"), c.feature("total_wordcounts"), 2),
    "encoded_trigrams": lambda c: features.encode(c.feature("trigrams"), c.feature("total_wordcounts"), 3),
    "SRP": lambda c: vectors.random_projection(c.texts()).select(f"`{ID}`", "SRP"),
    "SRP_bits": lambda c: vectors.random_projection(c.texts()).select(f"`{ID}`", "SRP_bits"),
}
#: Tokenizers by name.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"letters": tokenize, "words": document_words}
#: Other names of features.
ALIASES = {"document_length": "document_lengths", "srp": "SRP", "word_counts": "unigrams", "encoded_wordcounts": "encoded_unigrams", "SRPFeatures": "SRP", "encodedunigrams": "encoded_unigrams", "encodedbigrams": "encoded_bigrams", "encodedtrigrams": "encoded_trigrams"}


@dataclass(frozen=True)
class Options:
    """How a corpus is read: ``metadata_field``, ``format`` and ``compression`` of texts, ``id_field`` of the catalog, ``batch_size`` of stacks, ``tokenizer`` (a name of TOKENIZERS or a function from the text column to an array column)."""

    metadata_field: str | None = None
    format: str = "txt"
    compression: str | None = None
    id_field: str | None = None
    batch_size: int = 65536
    exclude_fields: tuple[str, ...] = ()
    tokenizer: str | Callable[[Column], Column] = "letters"


class Document:
    """One document of a corpus."""

    def __init__(self, corpus: Corpus, id: str) -> None:
        self.corpus, self.id = corpus, id

    @property
    def metadata(self) -> dict:
        return self.corpus.metadata.get(self.id)

    @property
    def full_text(self) -> str | None:
        row = self.corpus.identified_texts().filter(F.col("`@id`") == self.id).limit(1).collect()
        return row[0]["text"] if row else None

    def tokenize(self) -> list[str]:
        row = self.corpus.identified_texts().filter(F.col("`@id`") == self.id).select(document_words("text").alias("w")).limit(1).collect()
        return row[0]["w"] if row else []

    def __str__(self) -> str:
        return self.full_text or ""


@dataclass
class Metadata:
    """The typed catalog with ``@id`` and ``nc:id``."""

    tb: DataFrame
    forms: dict = field(default_factory=dict)

    @property
    def ids(self) -> DataFrame:
        return self.tb.select("`@id`")

    def id_index(self) -> DataFrame:
        return self.tb.select("`@id`", f"`{ID}`")

    def get(self, id: str) -> dict:
        """The row of an id as a dict; empty unless there is exactly one."""
        rows = self.tb.filter(F.col("`@id`") == id).limit(2).collect()
        return rows[0].asDict(recursive=True) if len(rows) == 1 else {}

    def to_flat_catalog(self, path: str) -> list[str]:
        """The flat relations as Parquet tables under ``path``; returns their names."""
        parts = cat.flat_catalog(self.tb.drop("stack"), cat.infer_forms(self.tb.drop("stack"), "@id"))
        for name, df in parts.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        return sorted(parts)


class Corpus:
    """Texts, catalog and features under ``dir``.

    Give ``texts`` (a folder or a file of lines), ``metadata`` (a catalog file),
    both, or ``bookstacks`` (Parquet with ``nc:text``).  A catalog alone needs
    ``metadata_field``; texts alone get a catalog of their ids.
    """

    def __init__(self, spark: SparkSession, dir: str, texts: str | None = None, metadata: str | None = None, bookstacks: str | None = None, cache: frozenset[str] = frozenset({"total_wordcounts"}), only_stacks: list[int] | None = None, options: Options = Options(), extra: dict[str, Feature] | None = None) -> None:
        if metadata and bookstacks:
            raise ValueError("give a catalog or bookstacks, not both")
        if not (texts or metadata or bookstacks):
            raise ValueError("give texts, a catalog or bookstacks")
        if metadata and not texts and not options.metadata_field:
            raise KeyError("metadata_field")
        self.spark, self.root, self.options, self.only_stacks = spark, dir, options, only_stacks
        self.sources = {"texts": texts, "metadata": metadata, "bookstacks": bookstacks}
        self.cache_set = frozenset(ALIASES.get(x, x) for x in cache)
        self.registry = REGISTRY | (extra or {})
        self._metadata: Metadata | None = None

    # -- catalog
    def _path(self, name: str) -> str:
        return files.join(self.root, name)

    def _source(self) -> str:
        return next(p for p in (self.sources["metadata"], self.sources["bookstacks"], self.sources["texts"]) if p)

    @property
    def metadata(self) -> Metadata:
        """The typed catalog; stored under the root and made anew when its source has changed."""
        if self._metadata is None:
            path, mark = self._path("metadata"), self._path("metadata.source")
            now = sinks.fingerprint(self._source())
            if not (sinks.is_complete(path) and files.exists(mark) and files.read_text(mark) == now):
                raw = self._raw_catalog()
                id = self.options.id_field or cat.infer_id_field(raw)
                numbered = cat.assign_ids(raw.drop(*self.options.exclude_fields), id)
                forms = cat.infer_forms(numbered, "@id")
                sinks.write_stacks(cat.typed(numbered, forms), path, self.options.batch_size)
                files.write_text(mark, now)
            self._metadata = Metadata(sinks.read_written(self.spark, path, self.only_stacks))
        return self._metadata

    def _raw_catalog(self) -> DataFrame:
        if self.sources["metadata"]:
            return catalogs.read_catalog(self.spark, self.sources["metadata"])
        if self.sources["bookstacks"]:
            return sources.stack_metadata(sources.read_stacks(self.spark, self.sources["bookstacks"])).drop(ID)
        return self._raw_texts().select("`@id`")

    # -- texts
    def _raw_texts(self) -> DataFrame:
        o = self.options
        if self.sources["texts"]:
            return sources.read_texts(self.spark, self.sources["texts"], o.format, o.compression)
        if self.sources["bookstacks"]:
            return sources.stack_texts(sources.read_stacks(self.spark, self.sources["bookstacks"]))
        raw = catalogs.read_catalog(self.spark, self.sources["metadata"])
        return sources.read_field(raw, o.metadata_field, o.id_field or cat.infer_id_field(raw))

    def identified_texts(self) -> DataFrame:
        """``@id``, ``nc:id``, ``text`` of every document of the catalog; null text where there is none."""
        return self.metadata.id_index().join(self._raw_texts(), "@id", "left")

    def tokens(self) -> Column:
        """The corpus's tokens as a column over ``text``."""
        chosen = self.options.tokenizer
        return (TOKENIZERS[chosen] if isinstance(chosen, str) else chosen)(F.col("text"))

    def texts(self) -> DataFrame:
        return self.identified_texts().select(f"`{ID}`", "text")

    # -- features
    def register_feature(self, name: str, make: Feature) -> None:
        self.registry[name] = make

    def feature(self, name: str, ids: str | None = ID) -> DataFrame:
        """A feature by name, keyed by ``nc:id``, by ``@id``, or by both with ``ids=None``."""
        name = ALIASES.get(name, name)
        if name not in self.registry:
            raise KeyError(f"no feature {name!r}; there are {', '.join(sorted(self.registry))}")
        path = self._path(name)
        if name in self.cache_set:
            if not sinks.is_complete(path):
                self.registry[name](self).write.mode("overwrite").option("compression", "zstd").parquet(path)
            df = self.spark.read.parquet(path)
        else:
            df = self.registry[name](self)
        if ids == ID or ID not in df.columns:
            return df
        df = self.metadata.id_index().join(df, ID)
        return df if ids is None else df.drop(ID)

    table = feature

    def cache(self, name: str) -> DataFrame:
        """The feature, stored from now on."""
        self.cache_set |= {ALIASES.get(name, name)}
        return self.feature(name)

    def iter_over(self, name: str, ids: str | None = ID) -> Iterator:
        """Rows of a feature as a stream, a partition at a time."""
        yield from self.feature(name, ids).toLocalIterator(prefetchPartitions=True)

    @property
    def total_wordcounts(self) -> DataFrame:
        return self.feature("total_wordcounts")

    def to_parquet(self, path: str, transformations: tuple[str, ...] = ("text", "document_lengths")) -> None:
        """Catalog and document-level features by stack."""
        parts = {t: self.feature(t) for t in transformations}
        sinks.export(self.metadata.tb, parts).repartition("stack").write.mode("overwrite").option("compression", "zstd").partitionBy("stack").parquet(path)

    # -- documents
    def get_document(self, id: str) -> Document:
        return Document(self, id)

    def documents(self) -> Iterator[Document]:
        for r in self.metadata.ids.toLocalIterator():
            yield Document(self, r["@id"])

    def first(self) -> Document:
        return Document(self, self.metadata.tb.orderBy(f"`{ID}`").first()["@id"])

    def random(self, seed: int | None = None) -> Document:
        return Document(self, self.metadata.tb.orderBy(F.rand(seed)).first()["@id"])

    def validate(self) -> dict:
        """Documents, documents without text, texts without a catalog row."""
        ids, raw = self.metadata.id_index(), self._raw_texts()
        found = {
            "documents": ids.count(),
            "without_text": ids.join(raw.filter("text is not null"), "@id", "left_anti").count(),
            "without_metadata": raw.join(ids, "@id", "left_anti").count(),
            "columns": json.loads(self.metadata.tb.schema.json())["fields"],
        }
        return found | {"valid": not found["without_text"] and not found["without_metadata"]}
