import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.text import chunk_index, common_prefix, document_words, extract_year, id_from_path, tokenize
from lexmill.operators import features, vectors
from tests.conftest import rows

DOCS = [(1, "a, b. A a"), (2, ""), (3, None), (4, "Год, 2020 год!"), (5, "x" * 30), (6, "a a a a a a a")]


def corpus(spark, data=DOCS):
    return features.texts(spark.createDataFrame(data, "id long, t string"), "id", "t")


def plain_tokens(text):
    return "".join(c if c.isalpha() else "\0" for c in text).split("\0")


def test_tokens_keep_empty_strings(spark):
    got = dict(rows(features.tokenization(corpus(spark))))
    assert got[1] == ("a", "", "b", "", "A", "a") and got[2] == ("",) and got[3] is None
    assert got[4] == tuple(plain_tokens(DOCS[3][1]))


def test_lengths(spark):
    assert rows(features.document_lengths(corpus(spark))) == [(1, 6), (2, 1), (3, None), (4, 9), (5, 1), (6, 7)]


def test_document_words(spark):
    df = spark.createDataFrame([("it's a_b ^ 12... né—ok",)], "t string")
    assert df.select(document_words("t")).first()[0] == re.findall(r"[\w^_]+|[^\w\s]+", "it's a_b ^ 12... né—ok")


def test_ngrams_by_hand(spark):
    for n in range(1, 6):
        want = Counter()
        for i, t in DOCS:
            tokens = plain_tokens(t) if t is not None else []
            want.update((i, *tokens[k : k + n]) for k in range(len(tokens) - n + 1))
        assert rows(features.ngram_counts(corpus(spark), n)) == sorted(((*k, v) for k, v in want.items()), key=repr), n


def test_nested_keeps_documents_without_ngrams(spark):
    nested = features.nested_ngrams(corpus(spark), 3, "trigrams")
    got = {r[0]: r[1] for r in rows(nested)}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] == () and got[5] == ()
    assert rows(features.explode_nested(nested, "trigrams")) == rows(features.ngram_counts(corpus(spark), 3))


def test_vocabulary_order_and_cap(spark):
    got = features.vocabulary(corpus(spark)).orderBy("wordid").collect()
    assert [r["wordid"] for r in got] == list(range(len(got)))
    assert [(-r["count"], r["token"]) for r in got] == sorted((-r["count"], r["token"]) for r in got)
    assert features.vocabulary(corpus(spark), 3).count() == 3


def test_encoding_keeps_rows_outside_the_vocabulary(spark):
    c = corpus(spark)
    grams, vocab = features.ngram_counts(c, 2), features.vocabulary(c, 2)
    coded = features.encode(grams, vocab, 2)
    assert coded.columns == ["nc:id", "word1", "word2", "count"] and coded.count() == grams.count()
    assert coded.agg(F.sum("count")).first()[0] == grams.agg(F.sum("count")).first()[0]
    assert coded.filter("word1 is null").count() > 0


def _coded_by_hand(data, n, cap):
    """Encoded counts of tokens ranked and cut by hand."""
    docs = [(i, plain_tokens(t)) for i, t in data if t is not None]
    total = Counter(w for _, tokens in docs for w in tokens)
    ids = {w: k for k, w in enumerate(sorted(total, key=lambda w: (-total[w], w))[:cap])}
    grams = Counter((i, *tokens[k : k + n]) for i, tokens in docs for k in range(len(tokens) - n + 1))
    return sorted(((i, *[ids.get(w) for w in words], c) for (i, *words), c in grams.items()), key=repr)


def test_words_outside_a_small_cap_by_broadcast_and_shuffle(spark, monkeypatch):
    c = corpus(spark)
    for chars in (features.BROADCAST_CHARS, -1):
        monkeypatch.setattr(features, "BROADCAST_CHARS", chars)
        for n, cap in ((1, 3), (2, 3), (3, 3), (2, features.VOCABULARY_CAP)):
            got = rows(features.encode(features.ngram_counts(c, n), features.vocabulary(c, cap), n))
            assert got == _coded_by_hand(DOCS, n, cap), (chars, n, cap)


def test_encoding_queries_take_the_whole_vocabulary(spark, tmp_path):
    from lexmill.plans import reference

    letters = "abcdefghij"
    word = lambda k: "".join(letters[int(d)] for d in str(k))
    data = [(1, " ".join(word(k) for k in range(5200))), (2, "a b a")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, n in (("encoded_unigrams", 1), ("encoded_bigrams", 2), ("encoded_trigrams", 3)):
        assert rows(reference.QUERIES[name](spark, str(tmp_path))) == _coded_by_hand(data, n, features.VOCABULARY_CAP), name


def test_global_rank_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string")
    assert features.global_rank(df, [F.asc("k")], "r").count() == 0


def chunks_by_hand(n, size):
    over = n % size
    if over * 3 < 2 * size:
        over += size
    half = over // 2
    return [0 if i < half else min(1 + (n - over) // size, 1 + (i - half) // size) for i in range(n)]


def test_chunks(spark):
    for n, size in ((25, 7), (3, 10), (0, 5), (100, 10), (7, 7), (20, 7)):
        df = spark.range(n).select(chunk_index(F.col("id"), F.lit(n), size).alias("c"), "id").orderBy("id")
        assert [r["c"] for r in df.collect()] == chunks_by_hand(n, size)
    assert [chunks_by_hand(25, 7).count(k) for k in range(4)] == [5, 7, 7, 6]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abß", max_size=6), st.text(alphabet="abß", max_size=6)), min_size=1, max_size=5))
def test_common_prefix(spark, pairs):
    import os

    got = spark.createDataFrame(pairs, "a string, b string").select(common_prefix("a", "b").alias("n")).collect()
    assert [r["n"] for r in got] == [len(os.path.commonprefix([a, b])) for a, b in pairs]


def test_small_functions(spark):
    df = spark.createDataFrame([("about 1850-51", "x/y/b.txt.gz"), ("none", "c.md"), (None, "d")], "t string, p string")
    assert [r[0] for r in df.select(extract_year("t")).collect()] == [1850, None, None]
    assert [r[0] for r in df.select(id_from_path("p")).collect()] == ["b", "c", "d"]
    assert df.select(tokenize("t")).collect()[2][0] is None


def test_word_share_and_top(spark):
    got = {r[0]: r[1:] for r in rows(features.word_share(corpus(spark), "a"))}
    assert got[6] == (7, 7, 1.0) and got[2] == (1, 0, 0.0) and 3 not in got
    assert [tuple(r) for r in features.top_ngrams(corpus(spark), 2, 1).collect()] == [("a", "a", 6)]


def test_projection_by_hand(spark):
    import hashlib
    import math

    dims = 320
    got = {r["nc:id"]: r for r in vectors.random_projection(corpus(spark), dims).collect()}
    assert got[2]["SRP"] == got[3]["SRP"] and abs(got[2]["SRP"][0] - math.sqrt(dims)) < 1e-4
    want = [0.0] * dims
    for token, n in Counter(t for t in plain_tokens(DOCS[0][1]) if t).items():
        bits = "".join(f"{b:08b}" for s in ("", "1") for b in hashlib.sha1((token + s).encode()).digest())
        for i in range(dims):
            want[i] += math.log(n / 4 * 1e5) * (1 if bits[i] == "1" else -1)
    assert all(abs(a - b) < 1e-3 for a, b in zip(got[1]["SRP"], want))
    packed = int("".join("1" if v > 0 else "0" for v in want), 2).to_bytes(dims // 8, "big")
    assert bytes(got[1]["SRP_bits"]) == packed


def test_close_pairs_by_hand(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = base + [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base] + [base[0], base[0]]
    data = [(i, [1.0 if v >> (63 - k) & 1 else -1.0 for k in range(64)]) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "id long, e array<double>").select("id", vectors.sign_words("e", 64).alias("w"))
    first = {v: values.index(v) for v in values}
    reps = sorted(first.values())
    want = [(i, j, bin(values[i] ^ values[j]).count("1")) for i in reps for j in reps if i < j]
    assert rows(vectors.close_pairs(df, "id", "w", 64, 5)) == sorted((x for x in want if x[2] <= 5), key=repr)
    assert dict(rows(vectors.signature_classes(df, "id", "w"))) == {i: first[v] for i, v in enumerate(values)}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts_in_place_are_those_after_a_shuffle(spark, n, monkeypatch):
    monkeypatch.setattr(features, "SLICE_TOKENS", 7)
    texts = [None, "", "a", "a b a b a", "a. b, a b", "x" * 500, "long " * 400, "é é É"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "`nc:id` long, text string").repartition(2)
    for ends in (None, [""]):
        assert rows(features.ngram_counts(df, n, ends, one_row_each=True)) == rows(features.ngram_counts(df, n, ends))
    assert rows(features.ngram_counts(df.limit(0), n, one_row_each=True)) == []


@pytest.mark.parametrize("most", [1, 5, 16])
def test_close_pairs_whatever_the_bands(spark, most, monkeypatch):
    rnd = random.Random(most)
    base = [rnd.getrandbits(64) for _ in range(12)]
    signs = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(0, 20))) for b in base for _ in range(5)]
    signed = [[x - (1 << 64) if x >> 63 else x] for x in signs]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, words array<long>")
    first = {}
    for i, x in enumerate(signs):
        first.setdefault(x, i)
    want = sorted(((first[x], first[y], bin(x ^ y).count("1")) for x in first for y in first if first[x] < first[y] and bin(x ^ y).count("1") <= most), key=repr)
    for bands in {1 + most // 3, 1 + most, vectors.choose_bands(60, 64, most)[0]}:
        if bands <= most and 64 // bands > 16:
            continue
        monkeypatch.setattr(vectors, "choose_bands", lambda *_, m=bands: (m, most // m))
        assert rows(vectors.close_pairs(df, "id", "words", 64, most)) == want
    monkeypatch.undo()
    assert vectors.choose_bands(10**9, 1280, 16) == (17, 0) and vectors.choose_bands(10**6, 64, 16)[1] > 0
