"""The spans that weak supervision adds, against a plain version and on planted cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import pii
from tests.llm import brute

D = "/root/testdata/sf0.01"
NAMES = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|pk_|rk_|xox[abprs]-|AIza|eyJ|glpat-|npm_|hf_)")
PUBLIC = re.compile(r"(?:commit|revision|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|guid|hash|integrity|build)[^a-z0-9]{0,4}$")
RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}")
SET = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"']{6,128}", re.I | re.A)


def candidates(text):
    """(start, end, form, votes, size, left, right) of the secret-like spans of a text, read plainly."""
    kind = lambda c: "e" if not c else "s" if c.isspace() else "l" if c.isalpha() else "d" if c in "0123456789" else "p"
    base = [tuple(map(int, x.split(":")[1:])) for x in brute.pii(text)]
    out = []
    for form, pattern in (("run", RUN), ("set", SET)):
        at = 0
        for m in pattern.finditer(text):
            gap, at = text[at : m.start()], m.end()
            s, e, value, before = m.start(), m.end(), m[0], gap[-40:].lower()
            if form == "run" and not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)):
                continue
            bare = re.sub(rf"(?i)^{NAMES}[\"']?[ ]?[=:][ ]?[\"']?", "", value)
            digits = len(re.sub("[^0-9]", "", value))
            shape = 1 if digits >= 2 and re.search("[A-Za-z]", bare) else 0 if digits else -1
            named = form == "set" or re.search(rf"{NAMES}[\"']?[ ]?[=:]?[ ]?[\"']?$", before)
            known = 1 if PREFIX.match(bare) or named else -1 if PUBLIC.search(before) else 0
            context = -1 if re.search(r"(?:[/.@]|://\S*)$", before) else 1 if form == "set" or re.search(r"[=:][ ]?[\"']?$", before) else 0
            n = e - s
            out.append((s, e, form, (shape, known, context), "a" if n < 10 else "b" if n < 16 else "c" if n < 24 else "d", kind(gap[-1:]), kind(text[e : e + 1])))
    return [c for c in out if not any(c[0] < b and a < c[1] for a, b in base)]


def accepted(found):
    """The candidates that a naive Bayes over plain EM labels accepts, row by row."""
    votes = np.array([c[3] for c in found])
    post = brute.em(votes, np.zeros(len(found), bool), prior=0.7, balance=True, belief=(0.1, 0.6), weight=2 + 0.2 * len(found)) if len(found) else np.zeros(0)
    feature = [("".join(c[2]), *map(str, c[3]), *c[4:]) for c in found]
    good, bad = 1 + post.sum(), 1 + (1 - post).sum()
    keep = []
    for f in feature:
        odds = math.log(good / bad)
        for j, v in enumerate(f):
            same = np.array([g[j] == v for g in feature])
            g, b = post[same].sum(), (1 - post)[same].sum()
            odds += math.log((g + 5 * (g + b) / (good + bad)) / (good + 5)) - math.log((b + 5 * (g + b) / (good + bad)) / (bad + 5))
        keep.append(odds >= math.log(9))
    return keep


@pytest.mark.parametrize("noise", [False, True])
def test_secrets_equal_a_plain_version(spark, noise):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    if noise:
        rows += [(10**6 + k, f"commit {k:040x} was built from /srv/files/{k:020d}abc and key AKIA{k:016d} or pwd: 'hunter{k:03}' twenty-one") for k in range(150)]
    found = {i: candidates(t or "") for i, t in rows}
    flat = [(i, c) for i in found for c in found[i]]
    keep = accepted([c for _, c in flat])
    want = {i: [] for i in found}
    for (i, c), k in zip(flat, keep, strict=True):
        if k:
            want[i].append(c)
    got = {r.id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = 0
    for i, r in got.items():
        apart, at = [], 0
        for c in sorted(want[i], key=lambda c: (c[0], -c[1])):
            if c[0] >= at:
                apart.append(f"secret:{c[0]}:{c[1]}")
                at = c[1]
        n += len(apart)
        assert [x for x in r.spans.split(",") if x.startswith("secret:")] == apart, i
    assert n > 5


def test_secrets_are_added_and_base_spans_stay(spark):
    got = pii.find(spark.read.parquet(f"{D}/documents.parquet"))
    r = got.agg(F.sum("n_added").alias("n"), F.count_if(F.expr("n_added > 0")).alias("docs"), F.count_if(F.expr("n_added > 0 and spans = base_spans")).alias("same")).first()
    assert r.n >= r.docs > 0 and r.same == 0


def test_kinds_beyond_the_base(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    rows = [(k, f"my iban is {ibans[k % 3]} and Dr. Anna Smith lives at {k + 1} Baker Street") for k in range(60)]
    rows += [(100 + k, f"XX00 1111 2222 3333 4445 is no account number, part {k}") for k in range(60)]
    kinds = {r.id: Counter(x.split(":")[0] for x in r.spans.split(",") if x) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kinds[k] == {"iban": 1, "name": 1, "address": 1} for k in range(60))
    assert not any(kinds[100 + k]["iban"] for k in range(60))


def test_odd_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a1" * 100_000, 0), (4, "token = " * 20_000, 0), (5, "Mr. " * 50_000, 0), (6, "DE00 " * 40_000, 0), (7, "1 A" * 60_000, 0), (7, "1 A" * 60_000, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_added int")
    got = pii.find(d).collect()
    assert len(got) == len(rows) and pii.find(d.limit(0)).count() == 0
    assert all(r.spans == "" for r in got if r.id in (1, 2))
