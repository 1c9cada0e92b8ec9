"""Operators on documents against plain versions, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontam, license, pii, quality, queries, simhash, weak
from tests.llm import brute

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e"), (6, "A B C D E"), (7, "word " * 30000), (7, "word " * 30000),
    (8, "x\x0by\x0cz\r\nq é Ünï 😀 " * 9), (9, "same line\nsame line\n \nsame line"), (10, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2"),
    (11, "9" * 60000), (12, "a@" * 20000), (13, "1.2.3.4.5.6.7.8 300.1.1.1 4111-1111 1111 1111 +1 (555) 222-3333 +12 +123456789012345678"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "kept", True) for i, t in ODD], "doc_id long, text string, lang string, spans string, kept boolean")


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_pii_base_spans(spark, sf, odd):
    rng = random.Random(4)
    noise = [(1000 + k, "".join(rng.choices("0123456789" * 3 + "..--  ++()@ab_%é😀\n", k=rng.randint(0, 120)))) for k in range(1500)]
    rows = documents(spark, sf) + noise
    got = {r.id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in dict(rows).items():
        assert got[i].base_spans == ",".join(brute.pii(t)), i
        assert set(filter(None, got[i].base_spans.split(","))) <= set(got[i].spans.split(","))
    for r in pii.find(odd).collect():
        assert r.base_spans == ",".join(brute.pii(dict(ODD)[r.id]))
    assert pii.find(odd.limit(0)).count() == 0


def test_pii_adds_spans_by_weak_supervision(spark):
    text = "call (555) 234-5678 or mail bob at mail dot com, order 5552345678 from 2001:0db8:85a3:0000:0000:8a2e:0370:7334"
    rows = [(k, f"host 10.0.{k}.7 mail a{k}@mail.com phone +44 20 7946 0{k:03d}") for k in range(40)] + [(99, text), (100, "look at this dot and run")]
    got = {r.id: r.spans.split(",") for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "phone:5:19" in got[99] and any(s.startswith("email:") for s in got[99])
    assert not any(s.startswith("phone:54") for s in got[99])


def test_simhash_classes(spark, sf, odd):
    rows = documents(spark, sf)
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)
    got = simhash.classes(odd).collect()
    want = brute.classes(ODD)
    assert len(got) == len(ODD) and all((r.fingerprint, r.component_id) == want[r.id] for r in got)
    assert simhash.classes(odd.limit(0)).count() == 0


def test_simhash_null_ids(spark):
    got = simhash.classes(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "zz")], "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3)]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_simhash_buckets_split(spark, chunk):
    """A hot bucket is dealt into chunks; links still join every pair within the radius."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(60)})
    signed = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), chunk=chunk).collect()
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert (prints[e.u] ^ prints[e.v]).bit_count() <= 64
        a, b = find(e.u), find(e.v)
        root[max(a, b)] = min(a, b)
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                assert find(a) == find(b)
    assert len({find(a) for a in range(len(prints))}) == len(set(want_roots(prints)))


def want_roots(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def test_drop_copies_keeps_columns(spark, odd):
    got = simhash.drop_copies(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    want = brute.classes(ODD)
    assert sorted(ids) == sorted({c for _, c in want.values()})


def test_decontamination(spark, sf, odd):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "one"), (901, None), (902, ""), (903, "a b c"), (904, bench_copy(spark, sf))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = documents(spark, sf) + [(10**6 + i, t) for i, t in ODD]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = decontam.annotate(d, b, keep=("doc_id",), block_words=500)
    parts = decontam.annotate(d, b, keep=("doc_id",), item_bytes=2000)
    for frame in (whole, parts):
        for r in frame.collect():
            n, hit, items, _ = brute.contamination(dict(rows)[r.row.doc_id], bench)
            assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, items), r.row.doc_id
    assert decontam.clean(odd, b).columns == odd.columns
    assert decontam.annotate(odd, b.limit(0), keep=("doc_id",)).filter("n_hit > 0").count() == 0
    assert decontam.annotate(odd.limit(0), b).count() == 0


def bench_copy(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text


def test_quality_counts(spark, sf, odd):
    rows = documents(spark, sf)
    for frame, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)), (odd.select("doc_id", "text", "kept"), dict(ODD))):
        for r in quality.score(frame).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.counts(texts[r.doc_id]), r.doc_id
    assert quality.score(odd.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{d}/documents.parquet")).withColumnRenamed("quality", "posterior")
    got = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.min(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] > 0.95 and right[1] == 1


def test_filter_docs_is_score(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in quality.filter_docs(d).collect()} == {r.doc_id for r in quality.score(d).filter("kept").collect()}


def test_em_finds_the_careless_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        v = tuple((-1 if (not good and rng.random() < 0.8) else 1) for _ in range(3)) + (rng.choice((-1, 1)),)
        counts[v] = counts.get(v, 0) + 1
    post = weak.fit(counts, most_false_alarms=0.6, prior=0.8)
    assert post[1, 1, 1, -1] > 0.9 and post[-1, -1, 1, 1] < 0.1
    assert weak.fit({}) == {}


def test_license_scan(spark, odd):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT Licence!"), (3, None), (4, "prose " * 9000), (5, "ALL RIGHTS RESERVED\nall rights reserved.")]
    got = {r.id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license, got[1].dice, got[1].n_lines) == ("Apache-2.0", 1.0, 1)
    assert got[2].license is None and got[3].n_lines == 0 and got[4].license is None
    assert (got[5].license, got[5].n_lines) == ("Proprietary", 2)
    assert license.scan(odd).count() == len(ODD) and license.scan(odd.limit(0)).count() == 0


def test_queries_have_contract_columns(spark, sf):
    want = {
        "op1_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op5_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op8_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
        "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op10_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(queries.queries()[name](spark, sf).dtypes).items(), name
