"""Command line: ``python -m lexmill.cli build|validate|embed ...``."""

from __future__ import annotations

import argparse
import json

from lexmill.corpus import Corpus, Options
from lexmill.operators import vectors
from lexmill.session import make_session
from lexmill.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill")
    p.add_argument("action", choices=["build", "validate", "embed"])
    p.add_argument("--dir", default=".", help="root of the corpus")
    p.add_argument("--texts", help="folder or file with texts")
    p.add_argument("--metadata", help="catalog file")
    p.add_argument("--bookstacks", help="folder of Parquet stacks")
    p.add_argument("--text-metadata-field", help="catalog field that holds the text")
    p.add_argument("--text-format", default="txt")
    p.add_argument("--metadata-id-field", help="catalog field that holds the id")
    p.add_argument("--only-stacks", nargs="+", type=int)
    p.add_argument("--output", help="folder for the vectors of embed; SRP below the root by default")
    p.add_argument("--dims", type=int, default=1280, help="length of the vectors of embed")
    p.add_argument("--targets", nargs="+", default=["total_wordcounts"], help="features to store")
    return p


def corpus_of(args: argparse.Namespace) -> Corpus:
    options = Options(metadata_field=args.text_metadata_field, format=args.text_format, id_field=args.metadata_id_field)
    return Corpus(make_session(), args.dir, args.texts, args.metadata, args.bookstacks, only_stacks=args.only_stacks, options=options)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    corpus = corpus_of(args)
    if args.action == "validate":
        found = corpus.validate()
        print(json.dumps(found))
        return 0 if found["valid"] else 1
    if args.action == "embed":
        vectors.write_vectors(corpus.texts(), args.output or files.join(args.dir, "SRP"), args.dims)
        return 0
    for target in args.targets:
        corpus.cache(target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
