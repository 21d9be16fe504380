"""Problem 5 on pages with a URL: the alignment and the pairing against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import page_difference as pd
from tests.conftest import rows


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_alignment_is_a_longest_common_subsequence(letters):
    rnd = random.Random(len(letters))
    for _ in range(300):
        a, b = ([rnd.choice(letters) for _ in range(rnd.randrange(25))] for _ in range(2))
        at = pd.shared_lines(a, b)
        assert at == sorted(set(at)) and len(at) == longest(a, b) and is_subsequence([a[i] for i in at], b)


def test_long_pages_are_aligned_whole():
    rnd = random.Random(1)
    a = [rnd.choice(["", "}", f"line {rnd.randrange(2000)}"]) for _ in range(6000)]
    b = [x for x in a if rnd.random() > 0.3] + ["end"]
    assert len(pd.shared_lines(a, b)) >= len(b) - 1


def brute(data):
    """Pages in order, each with the nearer of its neighbours."""
    order = sorted(data, key=lambda p: (p[1] is not None, p[1] or "", p[2] or "", p[0]))
    out = []
    for i, (key, host, path, text) in enumerate(order):
        near = [order[k] for k in (i - 1, i + 1) if 0 <= k < len(order) and order[k][1] == host and host is not None and order[k][3] is not None]
        if text is None:
            out.append((key, None, 0, 0, None))
        elif not near:
            out.append((key, None, text.count("\n") + 1, 0, text))
        else:
            pair = max(near, key=lambda p: pd.nearness(path or "", p[2] or ""))
            a, b = text.split("\n"), pair[3].split("\n")
            out.append((key, pair[0], len(a), longest([x.rstrip("\r") for x in a], [x.rstrip("\r") for x in b])))
    return sorted(out, key=repr)


def test_pages_are_paired_within_hosts(spark, monkeypatch):
    monkeypatch.setattr(pd, "BLOCK", 4)
    rnd = random.Random(3)
    data = []
    for i in range(90):
        host = rnd.choice(["a.example", "a.example", "a.example", "b.example", "c.example", None])
        path = rnd.choice([None, "", "/"]) if i % 17 == 0 else f"/{rnd.choice('xyz')}/{rnd.choice('pq')}{i % 7}.html"
        text = None if i % 13 == 0 else "\n".join(["<html>", f"<nav>{host}</nav>", *(rnd.choice(["own", "body", f"p {i}", ""]) for _ in range(rnd.randrange(6))), "</html>\r"])
        data.append((i, host, path, text))
    data.append((99, "alone.example", "/x", "a\nb"))
    df = spark.createDataFrame(data, "doc long, site string, url string, t string").withColumns({"rank": F.lit(1), "block": F.lit("z"), "host": F.lit(None).cast("string"), "own": F.lit(2)})
    got = pd.page_difference(df.repartition(3), "doc", "site", "url", "t").collect()
    want = brute(data)
    assert sorted([tuple(r) if r["pair_id"] is None else tuple(r)[:4] for r in got], key=repr) == want
    own = {r["page_id"]: r for r in got}
    assert all(r["own"] is None or r["own"].count("\n") + 1 == r["lines"] - r["shared"] or r["lines"] == r["shared"] for r in got)
    assert own[99]["own"] == "a\nb" and not any("<nav>" in (r["own"] or "") for r in got if r["pair_id"] is not None)
    assert rows(pd.page_difference(df.limit(0), "doc", "site", "url", "t")) == []


def test_copies_of_a_page_leave_nothing(spark):
    df = spark.createDataFrame([(1, "a", "/x", "p\nq"), (1, "a", "/x", "p\nq"), (2, "a", "/y", "")], "id long, h string, p string, t string")
    got = rows(pd.page_difference(df, "id", "h", "p", "t"))
    assert got[:2] == [(1, 1, 2, 2, "")] * 2 and got[2] == (2, 1, 1, 0, "")
