"""The quality rules' model against a plain one, and what it decides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality, weak
from tests.llm import brute

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in quality.score(docs).collect()}


def test_posteriors_equal_a_plain_em_over_all_rows(judged):
    texts, got = judged
    ids = sorted(texts)
    votes = np.array([brute.rule_votes(texts[i]) for i in ids])
    bad = np.array([brute.counts(texts[i])[5] for i in ids])
    assert bad.any() and not bad.all()
    want = brute.em(votes, bad)
    for i, v, b, p in zip(ids, votes, bad, want, strict=True):
        assert got[i].n_against == (v < 0).sum() and got[i].base_failed == b
        assert b or got[i].quality == pytest.approx(p, abs=1e-6), i
        assert got[i].kept == (not b and p >= 0.5)


def test_the_model_is_not_all_must_pass(judged):
    free = [r for r in judged[1].values() if not r.base_failed]
    kept_against = [r for r in free if r.kept and r.n_against]
    assert kept_against and any(not r.kept for r in free)
    assert {r.doc_id for r in free if r.kept} != {r.doc_id for r in free if not r.n_against}


def test_rates_are_free():
    """A labeler that wrongs a tenth of the good rows is found out, without a bound."""
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.8
    votes = np.stack([np.where(good, np.where(rng.random(6000) < 0.1, -1, 1), np.where(rng.random(6000) < 0.15, -1, 1))] + [np.where(good, 1, np.where(rng.random(6000) < 0.8, -1, 1)) for _ in range(3)], axis=1)
    counts = {}
    for v in votes:
        counts[tuple(map(int, v))] = counts.get(tuple(map(int, v)), 0) + 1
    post = weak.fit(counts)
    assert post[-1, 1, 1, 1] > 0.9 and post[1, -1, -1, 1] < 0.1
    plain = brute.em(votes, np.zeros(6000, bool))
    assert all(post[tuple(map(int, v))] == pytest.approx(p, abs=1e-6) for v, p in zip(votes[:500], plain[:500], strict=True))


def test_filter_docs_on_odd_tables(spark):
    prose = "the quick brown fox and the lazy dog went to the river with a friend. That was in the spring of a year which nobody there could name, for it was long ago. "
    rows = [(k, prose + f"tale {k} of the sea.", "a", 1, 2) for k in range(60)] + [(None, None, None, None, None), (7, prose + "tale 7 of the sea.", "a", 1, 2), (8, "junk### " * 40, "x", 1, 2), (9, "w" * 200_000, "x", 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _v string, _f long, n_words long")
    got = quality.filter_docs(d)
    assert got.columns == d.columns and quality.filter_docs(d.limit(0)).count() == 0
    assert got.filter("doc_id = 7").count() == 2 and got.filter("doc_id is null or text like 'junk%' or length(text) > 1000").count() == 0
    assert got.exceptAll(d).count() == 0 and got.count() == 61
    assert quality.score(d.limit(0)).count() == 0
    assert quality.score(d).filter(F.col("kept")).count() == 61
