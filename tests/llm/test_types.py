"""Ids of several types, clashing names, long values and empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, simhash, urlfilter
from tests.llm import brute

TEXTS = [None, "", "one two three four five", "one two three four five", "one two three four six", "a b", "a  b", "w " * 50_000]


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_near_copies_by_any_id(spark, kind):
    rows = [(str(k + 10), t, k) for k, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "`doc.id` string, text string, fp int").withColumn("doc.id", F.col("`doc.id`").cast(kind))
    want = brute.classes([(int(i), t) for i, t, _ in rows])
    got = {int(r.id): (r.fingerprint, int(r.component_id)) for r in simhash.classes(d, "doc.id").collect()}
    assert got == want
    kept = simhash.drop_copies(d, "doc.id")
    assert kept.columns == d.columns and kept.schema == d.schema and {int(r["doc.id"]) for r in kept.collect()} == {c for _, c in want.values()}
    assert simhash.drop_copies(d.limit(0), "doc.id").count() == 0


def test_rows_of_one_id_and_of_none(spark):
    d = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", "z"), (None, "a b c d e", "n"), (None, None, "n")], "doc_id int, text string, _keep string")
    got = simhash.drop_copies(d).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None", "None"] and simhash.drop_copies(d).collect() == got


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_chat_by_any_id(spark, kind):
    c = spark.createDataFrame([("1", 0, "user", "q", 1), ("1", 1, "assistant", "a " * 30_000, 2), ("2", None, None, None, 3)], "conv_id string, turn int, role string, text string, n_turns int").withColumn("conv_id", F.col("conv_id").cast(kind))
    got = {str(r.conv_id): r for r in chat.digests(chat.format_conversations(c)).collect()}
    assert got["1"].loss_sha256 == brute.sha("a " * 30_000) and got["1"].n_turns == 2 and got["2"].n_turns == 1
    assert chat.format_conversations(c).schema["conv_id"].dataType.simpleString() == kind
    assert chat.digests(chat.format_conversations(c.limit(0))).count() == 0


def test_url_lists_by_depth(spark):
    day = lambda n: datetime(2024, 1, n)
    entries = spark.createDataFrame([("com", "tld", day(5), "add"), ("b.a.com", "deep", day(1), "add"), ("x.org/p", "page", day(1), "add")], "value string, category string, at timestamp, action string")
    long = "http://" + ".".join(["l"] * 2000) + ".com/" + "p" * 50_000
    rows = [(1, "http://a.com/", day(6), "s"), (2, "http://c.b.a.com/", day(2), "s"), (3, "http://a.com/", day(2), "s"), (4, long, day(7), "s"), (5, "http://x.org/p", day(7), "s"), (6, "http://x.org/", day(7), "s")]
    d = spark.createDataFrame(rows, "page_id int, url string, fetched timestamp, since string").withColumn("value", F.lit(1)).withColumn("bucket", F.lit(2))
    got = {r.id: r.value for r in urlfilter.judge(d, entries).collect()}
    assert got == {1: "com", 2: "b.a.com", 3: None, 4: "com", 5: "x.org/p", 6: None}
    got = {r.id: r.value for r in urlfilter.judge(d, entries.filter("value <> 'com'")).collect()}
    assert got == {1: None, 2: "b.a.com", 3: None, 4: None, 5: "x.org/p", 6: None}
