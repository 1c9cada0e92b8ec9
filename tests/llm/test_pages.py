"""Page differencing against a plain version, and pages that are long or hostile."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import htmlpages

D = "/root/testdata/sf0.01"


def common_length(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
        before = now
    return before[-1]


@pytest.mark.parametrize("kept", [1 << 26, 40])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, kept):
    """Also where long pairs are halved."""
    monkeypatch.setattr(htmlpages, "KEPT_BITS", kept)
    rng = random.Random(5)
    for _ in range(400):
        a, b = (["".join(rng.choice("abcde")) for _ in range(rng.randint(0, 24))] for _ in range(2))
        places = [i for i, own in enumerate(htmlpages.unshared(a, b)) if not own]
        rest = iter(b)
        assert len(places) == common_length(a, b) and all(a[i] in rest for i in places)


def key(row):
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", row.url or "", re.S)
    return ((m[1].lower(), m[2]) if m else ("", "")) + (row.page_id,)


@pytest.mark.parametrize("marked", [True, False])
def test_whole_table_against_plain_neighbours(spark, marked):
    """As given; and with the naming markup turned into plain blocks, so that the alignment decides all."""
    pages = spark.read.parquet(f"{D}/pages.parquet")
    if not marked:
        pages = pages.withColumn("html", F.regexp_replace("html", r"(</?)(?:article|nav|footer)\b", "$1div").alias("html"))
        pages = pages.withColumn("html", F.regexp_replace("html", "<body>", "<body><div>All about us</div><p>Read more</p>"))
    rows = sorted(pages.collect(), key=key)
    got = {r.page_id: r.text for r in htmlpages.extract(pages).collect()}
    assert len(got) == len(rows)
    changed = 0
    for k, r in enumerate(rows):
        near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and key(rows[j])[0] == key(r)[0]]
        own = htmlpages.lines(r.html)
        other = htmlpages.lines(near[0].html) if near else None
        assert got[r.page_id] == htmlpages.main_text(own, other)
        if other is not None:
            a, b = [x for x, _ in own], [x for x, _ in other]
            assert len(a) - sum(htmlpages.unshared(a, b)) == common_length(a, b)
        changed += got[r.page_id] != htmlpages.main_text(own, None)
        if not marked and near and other and {x for x, _ in own} - {x for x, _ in other}:
            assert "All about us" not in got[r.page_id]
    assert (changed == 0) if marked else changed > len(rows) // 2


def test_unsure_parts_go_where_the_neighbour_shares_them(spark):
    page = lambda k, share: f"<article><h1>T{k}</h1><div class='share'>{share}</div><section class='related-work'>work {k}</section><p>text</p></article>"
    rows = [(k, f"http://h.com/{k}", page(k, "Share this")) for k in range(4)] + [(9, "http://alone.com/", page(9, "we share all we have"))]
    got = {r.page_id: r.text for r in htmlpages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {k: f"T{k} work {k} text" for k in range(4)} | {9: "T9 we share all we have work 9 text"}


LONG = {
    "nested": "<div>" * 40_000 + "x",
    "open tags": "<a " * 60_000,
    "open quotes": '<a "' * 60_000 + ">",
    "inline before paragraphs": "<b>" * 40_000 + "<p></p>" * 40_000,
    "comments": "<!--" * 60_000,
    "brackets": "<" * 200_000 + ">",
    "scripts": "<script>" * 40_000,
    "stray ends": "<div>" * 20_000 + "</span>" * 40_000,
    "attributes": "<a class" + " class=x" * 60_000 + ">y",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_pages_take_time_in_proportion(name):
    began = time.time()
    htmlpages.lines(LONG[name])
    assert time.time() - began < 5


def test_long_pairs_of_pages():
    a = [f"line {k}" for k in range(4000)]
    b = random.Random(1).sample(a, len(a))
    began = time.time()
    htmlpages.unshared(a, b)
    htmlpages.unshared([f"{k % 50}" for k in range(20_000)], [f"{k % 49}" for k in range(20_000)])
    assert time.time() - began < 10


def test_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "http://h.com/a", "<p>menu</p><p>one</p>", "x", 1), (1, "http://h.com/a", "<p>menu</p><p>one</p>", "y", 2), (None, "http://h.com/a", "<p>menu</p><p>two</p>", None, None), (2, "http://h.com/a?q=1", None, "z", 0), (3, "no url", "<p>alone", "z", 0)]
    d = spark.createDataFrame(rows, "page_id string, url string, html string, host string, bucket int")
    got = htmlpages.extract(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert sorted(r.text for r in got.collect()) == ["", "alone", "menu one", "one", "two"]
    assert htmlpages.extract(d.limit(0)).count() == 0
