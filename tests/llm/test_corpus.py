"""Operators 11 to 13 against plain versions on small hostile tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import centroids, collocations, winnowing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least, top, share=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right))
    return sorted((lang, r, x[2].decode(), *x[3:], n[lang], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top], 1))


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (5, 7), (1000, 10)])
def test_collocations_equal_a_plain_count(spark, least, top):
    r = random.Random(least)
    words = ["a", "B", "new", "york", "city", "é", "hot", "\x00", "x y", "ab\x1c"]
    rows = [(r.choice([" ", "\t ", ". ", ",", "\n"]).join(r.choices(words, [9, 5, 5, 5, 4, 2, 9, 1, 1, 1], k=r.randint(0, 30))), r.choice(["en", "de", None, "und"])) for _ in range(200)]
    rows += [("new york city hall " * 40, "en"), ("new york city hall", "en"), ("hot " * 500, "en"), (None, "en"), ("", None), (" .,;\n", "de")] + [("same text here now", "de")] * 50
    d = spark.createDataFrame([(*x, "t", 1) for x in rows], "text string, lang string, phrase string, f int").repartition(5)
    got = sorted(tuple(x) for x in collocations.collocations(d, least=least, top=top).collect())
    assert got == plain_collocations(rows, least, top)
    assert bool(got) == (least < 1000)


def test_collocations_of_an_empty_table_and_of_slices(spark, monkeypatch):
    d = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(d).count() == 0
    long = "".join(f"word{k} and more{'.' if k % 7 == 0 else ' '}" for k in range(300_000))
    batch = pa.record_batch({"text": ["x" * (3 << 20)] * 3 + [long, None, "z"], "lang": ["en"] * 6})
    parts = list(collocations._slices(batch))
    assert [p.num_rows for p in parts[:3]] == [1, 1, 1] and parts[-1].num_rows == 2
    assert len(parts) > 5 and "".join(p.column("text")[0].as_py() for p in parts[3:-1]) == long
    assert all(p.column("text")[0].as_py().endswith(".") for p in parts[3:-2])


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    rows = [(" ".join(random.Random(k).choices("abcdefgh", k=40)), "en") for k in range(60)]
    d = spark.createDataFrame(rows, "text string, lang string")
    before = sorted(map(tuple, collocations.collocations(d, least=4).collect()))
    monkeypatch.setattr(collocations, "pair_filter", lambda pairs: np.full(collocations.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, collocations.collocations(d, least=4).collect())) == before == plain_collocations(rows, 4, 2000)


def plain_clusters(rows, k, dims, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else old for j, old in enumerate(c)]
    best = [near(v) for _, v in kept]
    per = Counter()
    for d, j in best:
        per[j] += d
    held = lambda x: x if x < 1 << 63 else None
    return sorted((repr((i, j, held(d), held(per[j]), held(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for (i, _), (d, j) in zip(kept, best, strict=True)))


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_clusters_equal_a_plain_count(spark, size):
    r = random.Random(3)
    rows = [(i, [r.uniform(-size, size) for _ in range(4)]) for i in range(300)]
    rows += [(500 + i, [0.5, 0.25, -0.5, 1.0]) for i in range(100)] + [(7, rows[7][1]), (None, [1.0, 2.0, 3.0, -4.0]), (901, None), (902, []), (903, [1.0] * 3), (904, [1.0] * 5), (905, [1.0, None, 1.0, 1.0]), (906, [1.0, float("nan"), 1.0, 1.0]), (907, [1.0, float("-inf"), 1.0, 1.0])]
    d = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = centroids.cluster(d, k=5, dims=4).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain_clusters(rows, 5, 4, 3)
    few = d.filter("vec_id in (1, 2)")
    assert sorted(repr(tuple(x)) for x in centroids.cluster(few, k=5, dims=4).collect()) == plain_clusters(rows[1:3], 5, 4, 3)
    assert centroids.cluster(d.filter("vec_id > 900"), k=5, dims=4).count() == 0
    assert centroids.cluster(d.limit(0)).columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain_winnow(text, k, window):
    if not text:
        return []
    k = min(k, len(text))
    h = [int(winnowing.gram_hashes(np.array([ord(c) for c in text[i : i + k]], np.uint32), k)[0]) for i in range(len(text) - k + 1)]
    window, out = min(window, len(h)), []
    for i in range(len(h) - window + 1):
        at = max(j for j in range(i, i + window) if h[j] == min(h[i : i + window]))
        if not out or out[-1] != (h[at], at):
            out.append((h[at], at))
    return out


@pytest.mark.parametrize(("k", "window", "block"), [(16, 24, 1 << 20), (1, 1, 7), (5, 4, 3), (12, 9, 50), (7, 24, 1)])
def test_winnowing_equals_a_plain_scan(k, window, block):
    r = random.Random(k)
    for text in ["", "x", "short", "a" * 300, "ab" * 100, "".join(r.choices("ab", k=400)), "".join(chr(r.randint(32, 0x1F600)) if r.random() < 0.3 else "e" for _ in range(300)).replace("\ud800", "")]:
        hashes, places = winnowing.winnow(text, k, window, block)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain_winnow(text, k, window)
        if k == winnowing.K:
            h, p = winnowing.unpacked(winnowing.packed(hashes, places))
            assert (h.tolist(), p.tolist()) == (hashes.tolist(), places.tolist())


def test_a_shared_passage_shares_a_fingerprint():
    r = random.Random(1)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    for _ in range(200):
        passage = word(winnowing.K + winnowing.WINDOW - 1)
        a, b = word(r.randint(0, 60)) + passage + word(r.randint(0, 60)), word(r.randint(0, 60)) + passage + word(r.randint(0, 60))
        (ha, pa_), (hb, pb) = winnowing.winnow(a), winnowing.winnow(b)
        both = [(x, y) for i, x in zip(ha, pa_, strict=True) for j, y in zip(hb, pb, strict=True) if i == j and a[x : x + winnowing.K] == b[y : y + winnowing.K]]
        assert both


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_documents_meet_their_next_one(spark, parts):
    r = random.Random(parts)
    texts = ["".join(r.choices("abc dé\U0001f600", k=r.randint(0, 90))) for _ in range(120)]
    rows = [(3 * k - 100, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "x"), (1003, "y" * 5000), (1004, "y" * 5000)]
    r.shuffle(rows)
    d = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, range int, h string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x.id: x for x in winnowing.fingerprint(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows.sort()
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        mark = lambda x: winnowing.packed(*winnowing.winnow(x))
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (mark(t), mark(edited))
        assert x.near_edited == winnowing.likeness(winnowing.winnow(t)[0], winnowing.winnow(edited)[0]) and 0 <= x.near_next <= 1
        assert x.near_next == winnowing.likeness(winnowing.winnow(t)[0], winnowing.winnow(after)[0])
    assert got[1000].fingerprint == got[1001].fingerprint == "" and got[1000].near_next == 1.0 and got[1003].near_next == 1.0


def test_fingerprints_of_odd_tables(spark):
    kinds = "doc_id long, text string"
    assert winnowing.fingerprint(spark.createDataFrame([], kinds)).count() == 0
    one = winnowing.fingerprint(spark.createDataFrame([(5, "abcd")], kinds)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1.0
    many = winnowing.fingerprint(spark.createDataFrame([(None, "first text"), (1, "same"), (1, "same"), (2, "last")], kinds)).collect()
    assert sorted(str(x.id) for x in many) == ["1", "1", "2", "None"]
    assert next(x for x in many if x.id == 2).edited_sha256 == hashlib.sha256(b"lasf").hexdigest()
