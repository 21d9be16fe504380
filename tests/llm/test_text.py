"""Problems 5, 8 and 10 on small texts."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, markup, stuffing
from tests.conftest import rows

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "\n\n", "a", "it's we'll 'tis '' 's I'Ve", "  two  blanks\n\n end  ", "tab\t\tx \n y\r\nz", "naïve 數字 ١٢٣ ½ Ⅷ 😀😀 ́x", "<|endoftext|> <|x|>", "\u00a0\u2003x\u3000 y\x1c z", "\ufeffx",
    "x" * 3000, " " * 500, "\n" * 300 + "a", "ab" * 2000 + "'" * 50, "don't1st 'd'm're", "a\u2009\u2009b \u2009c",
]


def library(texts):
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_library():
    rnd = random.Random(2)
    alphabet = "abcXYZ019 '\n\t.,-_é數\u00a0😀sdtmlrv"
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)]
    assert bpe.encode_column(pa.array(texts, pa.string()), bpe.DEFAULT_VOCABULARY).to_pylist() == library(texts)


def test_slices_of_a_column():
    column = pa.array(TEXTS * 2, pa.string()).slice(5, 20)
    assert bpe.encode_column(column, bpe.DEFAULT_VOCABULARY).to_pylist() == library(column.to_pylist())
    assert bpe.encode_column(pa.array([], pa.string()), bpe.DEFAULT_VOCABULARY).to_pylist() == []


def test_walk_is_the_whole_segmentation():
    t = bpe.transducer(bpe.DEFAULT_VOCABULARY)
    for word in (b"antidisestablishmentarianism", b"x" * 1000, b"ab" * 700, bytes(range(97, 123)) * 20):
        assert list(t.walk(word)) == library([word.decode()])[0]


def merged(word, merges):
    """The plain way: the first merge of the list that applies, leftmost first, again and again."""
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(word)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get((parts[i], parts[i + 1]), 10**9), i))
        if (parts[best], parts[best + 1]) not in rank:
            break
        a, b = parts[best], parts[best + 1]
        out, i = [], 0
        while i < len(parts):  # every occurrence of this pair
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def vocabulary_file(path, letters, merges):
    vocab = {x: i for i, x in enumerate(dict.fromkeys([*letters, *(a + b for a, b in merges)]))}
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}))
    return vocab


def test_a_step_back_beyond_what_is_written(tmp_path):
    letters = [chr(c) for c in range(33, 127)]
    chain = [(a, b) for a, b in zip(letters, letters[1:])][::-1]  # each merge comes before the one to its left
    vocab = vocabulary_file(tmp_path / "v.json", letters, chain)
    t = bpe.Transducer(str(tmp_path / "v.json"))
    crossed = 0
    for end in range(2, len(letters) + 1):
        word = "".join(letters[:end])
        want = [vocab[x] for x in merged(word, chain)]
        assert list(t.ids(word.encode())) == want == list(t.walk(word.encode(), hold=0))
        try:
            list(t.walk(word.encode()))
        except bpe.Crossed:
            crossed += 1
    assert crossed > 30


@pytest.mark.parametrize("seed", range(12))
def test_walk_against_the_plain_merge_loop(tmp_path, seed):
    rnd = random.Random(seed)
    letters = list("abcd"[: 2 + seed % 3])
    made, merges = list(letters), []
    for _ in range(40):
        pair = (rnd.choice(made), rnd.choice(made))
        if pair not in merges and "".join(pair) not in made and len("".join(pair)) <= 12:
            merges.append(pair)
            made.append("".join(pair))
    vocab = vocabulary_file(tmp_path / "v.json", letters, merges)
    t = bpe.Transducer(str(tmp_path / "v.json"))
    for n in (1, 7, 60, 400, 3000):
        word = "".join(rnd.choice(letters) for _ in range(n))
        want = [vocab[x] for x in merged(word, merges)]
        assert list(t.ids(word.encode())) == want
        assert list(t.walk(word.encode(), hold=0)) == want


def test_long_stretches_are_those_of_the_library():
    rnd = random.Random(9)
    t = bpe.transducer(bpe.DEFAULT_VOCABULARY)
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "xyzzy", "éüaå"):
        word = "".join(rnd.choice(alphabet) for _ in range(8000))
        assert list(t.ids(word.encode())) == library([word])[0]


def test_encode_and_decode_frames(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(0, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    ids = bpe.encode(df)
    assert ids.columns == ["doc_id", "tokens", "ids"]
    got = sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=repr)
    assert got == sorted(((i, x) for (i, _), x in zip(data, library([t for _, t in data]))), key=repr)
    assert rows(bpe.decode(ids).select("doc_id", "text")) == sorted(((i, t or "") for i, t in data), key=repr)
    assert {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df).collect()}[12] == len(library([TEXTS[12]])[0])
    assert bpe.encode(df.limit(0)).count() == 0


def test_utf8_reader():
    r = bpe.Utf8Reader()
    assert "".join(r.feed(bytes([b])) for b in "aé數😀".encode()) == "aé數😀"
    assert r.feed(b"\xe2\x82") == "" and r.feed(b"x") == "\ufffdx" and r.feed(b"\xf0", final=True) == "\ufffd"


PROSE = [
    "Weights < 3 lb were \"quiet\", those over it weren't.", "It cost $5 in spring and $20 by winter.", "House #37 belonged to the Q&A bureau.", "See C:\\ledger\\parish.txt.", "The label read {lantern}.", "Roughly ~41 % (see note 4).",
    "A = B + c, they joked.", "The tower [sic] was measured.", "3) bridge / harbour | quarry: 100% crowded.", "If a < b and b > 6, it breaks.", "An arrow -> leads <- back.", "Pages 1--89 are lost...", "engine_weaver_id was blank.",
    "5 * 3 * 5 feet.", "They wrote `archive' in the old style, at 5/- & 6/- a piece.", "rated *** out of five", "a[1] equals b[6]", "", None, "x" * 20000, "He said: -- no.", "100 & more; less",
]
MARKED = [
    "a <I>b</I> c", "x</p> y", "l<br />g", "<span class=x>b</span>", "a <!-- b --> c", "x&nbsp;y", "&#8217;x", "&lt;b&gt;", "f<sup>2</sup>", "**a b** c", "__a b__ c", "~~a~~", "`f()` x", "[a](http://b.example/)", "![](fig7.png)", "# Title", "Title\n=====\ntext",
    "- a\n- b", "| a | b |\n|---|:-:|\n| c | d |", "> quoted", "x.[^1]", "[[a|b]]", "{{cite book|x}}", "''a''", "== A ==", "[http://a.example b]", "a\\footnote{b}", "\\textit{a}", "\\ldots b \\& c", "\\(x^2\\)", "$\\beta_0$", "{\\it a}", "``a b''", "\\'etude", "5\\,\\% of it",
]


#: Prose of other origin than the tables.
OTHER_PROSE = [
    "It costs $5_000 today or $6 tomorrow.", "See R&Dept; for more.", "Use __init__ here, and __main__ there.", "x = [a][b]", "take m[i][j] and rows[0][col]", "- Where are you?\n- Here, she said.", "- No!\nHe paused.\n- \"Never.\"",
    "Pay $20{ish} or $30.", "AT&T; that is a firm.", "costs US$4_a and US$5",
]
OTHER_MARKED = ["$x_1$ and more", "caf&eacute; &amp; bar", "&hellip;", "__bold__ word", "see [the list][ref]", "- milk\n- eggs.", "* One.\n* Two.", "+ a.\n+ b."]


def test_prose_and_markup_of_other_origin(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(OTHER_PROSE + OTHER_MARKED)], "id long, t string")
    got = {r["id"]: r["has_markup"] for r in markup.find_markup(df, "t").collect()}
    assert [t for i, t in enumerate(OTHER_PROSE + OTHER_MARKED) if got[i] != (i >= len(OTHER_PROSE))] == []


def test_markup_is_told_from_prose(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE + MARKED)], "id long, t string").withColumn("text", F.lit("<b>clash</b>"))
    got = {r["id"]: r["has_markup"] for r in markup.find_markup(df, "t").collect()}
    assert [t for i, t in enumerate(PROSE + MARKED) if got[i] != (i >= len(PROSE))] == []


def test_clean_texts_keep_structure(spark):
    data = [
        ("h", "<h2>A &amp; b</h2><ul><li>x</li><li>y</ul><pre><code>if (a&lt;b) { }</code></pre><math><mi>x</mi><mo>=</mo><mn>1</mn></math><!-- c -->"),
        ("m", "# T #\n\n- a\n* b\n\n```c\nx[0] = '*';\n```\n\nsee [n](http://a.example/a_(b)) $z^2$ **w**\n\n| a | b |\n|---|---|\n| c | d |"),
        ("w", "== T ==\n* [[x|a]]\n# [[b]]\n{{Infobox\n| n = 1\n}}\nso <math>\\frac{a}{b}</math> holds {{cn}}.<ref name=\"x\">p</ref>\n[[Category:C]]"),
        ("l", "\\section{T}\n\\begin{itemize}\n  \\item a\n  \\item b\n\\end{itemize}\n\\begin{verbatim}\n# x **y**\n\\end{verbatim}\n\\'etude~\\cite{k}, $a_n$. % note\n``q''"),
        ("n", None), ("e", ""), ("p", "plain\r\ntext"),
    ]
    df = spark.createDataFrame(data, "id string, text string").withColumn("clean", F.lit(1))
    got = {r["rec_id"]: r for r in markup.clean_texts(df, "id", "text").collect()}
    assert got["h"]["headings"] == ["A & b"] and got["h"]["list_items"] == ["x", "y"] and got["h"]["code"] == ["if (a<b) { }"] and got["h"]["formulas"] == ["x = 1"]
    assert got["m"]["headings"] == ["T"] and got["m"]["list_items"] == ["a", "b"] and got["m"]["code"] == ["x[0] = '*';"] and got["m"]["formulas"] == ["z^2"]
    assert "see n z^2 w" in got["m"]["clean"] and "a | b\nc | d" in got["m"]["clean"] and "    x[0] = '*';" in got["m"]["clean"]
    assert got["w"]["headings"] == ["T"] and got["w"]["list_items"] == ["a", "b"] and "so \\frac{a}{b} holds." in got["w"]["clean"] and "Category" not in got["w"]["clean"]
    assert got["l"]["headings"] == ["T"] and got["l"]["list_items"] == ["a", "b"] and got["l"]["code"] == ["# x **y**"] and "e\u0301tude, a_n." in got["l"]["clean"] and "\u201cq\u201d" in got["l"]["clean"]
    assert got["n"]["clean"] is None and got["e"]["clean"] == "" and got["p"]["clean"] == "plain\r\ntext"


STUFFED = [
    "buy kettle, cheap kettle, buy lamp, cheap lamp, buy kettle, cheap lamp, buy lamp, cheap kettle, buy kettle, buy lamp, cheap lamp",
    "A fair day came and the mill was open. " + "w\u00adholesale drill D1SC0UNT dr.ill wholesale drill discount la\u200bmp " * 6,
    "#buy_lamp #cheap-lamp #buylamp #cheap_kettle #buykettle #buy-kettle #cheap_lamp #buy_lamp #cheap-kettle",
    "\n".join(f"- [cheap lamp](http://shop{i}.example/lamp?id={i})" for i in range(12)),
    "\n".join(f"http://shop{i}.example/lamp/{i}" for i in range(12)),
    '{"name": "x", "keywords": [' + ", ".join(['"buy lamp"', '"best lamp"', '"buy drill"', '"best drill"'] * 8) + "]}",
    '<html><head><meta name="keywords" content="' + ", ".join(["buy lamp", "best lamp"] * 12) + '"></head></html>',
]
HONEST = [
    None, "", "short", "The mill was sold in spring. Nobody knew why the river had changed its course. A late ferry left the harbour, and few people saw it go.",
    "\n".join(f"def price_{i}(lamp, rate=0.{i}):\n    return lamp.price({i}) * rate" for i in range(20)),
    "id,item,score\n" + "\n".join(f"{i},lamp,{i / 7:.3f}" for i in range(60)),
    "\n".join(f"- [Note {i}](https://a{i}.example/x): The {w} garden was described by the committee, and the tower was left alone for many years." for i, w in enumerate("late early old new red tall small wide".split())),
    "".join(f".a{i}{{margin:{i}px;color:#d73}}" for i in range(200)),
]


def test_stuffed_pages(spark):
    data = [(i, f"r{i % 3}", t) for i, t in enumerate(STUFFED + HONEST)] + [(100, None, STUFFED[0])]
    df = spark.createDataFrame(data, "doc_id long, repo string, text string").withColumn("host", F.lit("clash")).withColumn("phrase", F.lit(1))
    got = {r["doc_id"] for r in stuffing.stuffed_pages(df).collect()}
    assert got == {*range(len(STUFFED)), 100}
    assert rows(stuffing.stuffed_pages(df.limit(0))) == []


#: A page half list: each word twice or three times, so density alone doesn't tell.
HALF = "oak lamp, oak kettle, elm lamp, elm kettle, oak drill, elm drill, fir lamp, ash stool, oak bench, fir kettle, yew chest, elm shelf"


def test_hosts_decide_about_pages_that_are_half_a_list(spark):
    lim = stuffing.Limits()
    other = "buy lamp, oak kettle, oak table, elm table, fir table, ash table, yew table, pine drill, pine stool, pine bench, pine chest, pine shelf"
    text = HALF + ", oak lamp, elm lamp, oak kettle, elm kettle, fir drill, fir kettle, oak drill, elm drill"
    low = stuffing.look(text, lim)[1]
    assert lim.evidence - lim.replicated_weight <= low < lim.evidence
    schema = "doc_id long, repo string, text string"
    alone = spark.createDataFrame([(1, "a", text), (2, "a", other)], schema)
    apart = spark.createDataFrame([(1, "a", text), (2, "b", other)], schema)
    found = lambda df, lim=lim: {r["doc_id"] for r in stuffing.stuffed_pages(df, lim).collect()}
    assert 1 not in found(alone) and 1 in found(apart)
    assert 1 not in found(apart, stuffing.Limits(hosts=10**9))  # hosts switched off
    pages = {r["doc_id"]: r for r in stuffing.listed_pages(apart).collect()}
    assert pages[1]["replicated_share"] > 0.8 and {r["doc_id"]: r for r in stuffing.listed_pages(alone).collect()}[1]["replicated_share"] == 0


def test_replicated_share_against_brute_force(spark):
    rnd = random.Random(4)
    words = "oak elm fir ash yew lamp kettle drill stool bench chest shelf".split()
    data = [(i, f"r{i % 4}" if i % 5 else None, ", ".join(f"{rnd.choice(words)} {rnd.choice(words)}" + str(rnd.choice(["", "", f" w{chr(97 + i)}x"])) for _ in range(rnd.randrange(10, 30)))) for i in range(20)]
    lim = stuffing.Limits()
    seen = {i: (r or "", stuffing.look(t, lim)) for i, r, t in data}
    hosts = {}
    for r, s in seen.values():
        for a, b, _ in s[2] if s else []:
            hosts.setdefault((1, a), set()).add(r)
            hosts.setdefault((2, b), set()).add(r)
    want = {}
    for i, (_, s) in seen.items():
        if s:
            n = sum(c for _, _, c in s[2])
            want[i] = round(sum(c for a, b, c in s[2] if max(len(hosts[1, a]), len(hosts[2, b])) >= 2) / n, 9)
    got = stuffing.listed_pages(spark.createDataFrame(data, "doc_id long, repo string, text string"))
    assert {r["doc_id"]: round(r["replicated_share"], 9) for r in got.collect()} == want


def test_very_long_texts_end_soon():
    lim = stuffing.Limits()
    for text in ("x" * 200_000, "<" * 50_000, "a." * 50_000, "word " * 40_000, "A1" * 50_000):
        stuffing.look(text, lim)
