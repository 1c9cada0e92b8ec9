"""Topics, convergence and odd tables of the mixing operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing


def test_topics_come_from_words(spark):
    cases = [(None, "general"), ("", "general"), ("Licensed under the MIT LICENSE, no warranty", "law"), ("the software ran on a server; its license", "technology"), ("a court and a server", "law"), ("lawless servers", "general"), ("Der Arzt und die Krankheit", "health")]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert {r.k: r.x for r in d.select("k", mixing.topic_of(F.col("t")).alias("x")).collect()} == {k: w for k, (_, w) in enumerate(cases)}


def sums(table):
    worst = 0.0
    for axis in mixing.AXES:
        have, want = Counter(), {}
        for r in table:
            have[r[axis]] += r.weight
            want[r[axis]] = r[f"t_{axis}"]
        worst = max(worst, *(abs(have[v] / want[v] - 1) for v in want))
    return worst


def test_raking_goes_on_until_the_targets_are_met(spark):
    cells = [(f"s{a}", f"l{b}", f"t{c}", float((a * 7 + b * 3 + c * 5) % 11 + 1) ** 3) for a in range(6) for b in range(4) for c in range(3)]
    t = mixing.tempered(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double"), 0.2)
    assert sums(mixing.rake(t).collect()) < 1e-8 and sums(mixing.rake(t, tolerance=1e-2).collect()) < 1e-2


def test_targets_out_of_reach_end_too(spark):
    """A language of one source: both targets cannot hold, the last axis is met."""
    cells = [("a", "x", "t", 900.0), ("b", "y", "t", 90.0), ("c", "y", "u", 10.0)]
    table = mixing.rake(mixing.tempered(spark.createDataFrame(cells, "source string, lang string, topic string, tokens double"), 0.3)).collect()
    have, want = Counter(), {}
    for r in table:
        have[r.topic] += r.weight
        want[r.topic] = r.t_topic
    assert all(have[v] == pytest.approx(want[v]) for v in want)


def test_clashing_names(spark):
    rows = [(k, "some words " * (k % 9 + 1), f"s{k % 3}", "en", k, 0.5, "mine") for k in range(300)] + [(5, None, None, None, None, None, None), (6, "w " * 200_000, "s1", "en", 1, 1.0, "long")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int, probability double, topic string")
    got = mixing.weigh(d, keep=("source", "tokens", "doc_id"), budget=0.9)
    assert got.columns == ["id", "source", "lang", "topic", "tokens", "probability", "kept", "keep_source", "keep_tokens", "doc_id"] and got.count() == len(rows)
    assert got.filter("keep_source is null").first().probability == 1.0
    assert set(r.topic for r in mixing.weigh(d, topic="topic", budget=0.9).select("topic").distinct().collect()) == {"mine", "", "long"}
    out = mixing.mix_docs(d, budget=0.9)
    assert out.columns == d.columns and out.exceptAll(d).count() == 0 and mixing.mix_docs(d.limit(0)).count() == 0
