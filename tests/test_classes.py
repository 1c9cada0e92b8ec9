"""Queries and tasks of one class are answered once: the rows are those of the plain forms, without their pairs."""

from pyspark.sql import functions as F

from quillgraph.operators import workflow as W
from quillgraph.plans import registry
from quillgraph.plans import retrieval_queries as RQ


def test_sibling_counts(spark):
    up = [("a", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "y"), ("e", "z"), ("f", "gone"), ("g", "x"), ("g", "y")]
    down = [("x", "a"), ("x", "b"), ("x", "c"), ("y", "c"), ("y", "d"), ("z", "e"), ("x", "b"), ("y", "h")]
    edges = spark.createDataFrame([(s, "child_of", t) for s, t in up] + [(s, "parent_of", t) for s, t in down], "source_id string, edge_type string, target_id string")
    tasks = spark.createDataFrame([(i,) for i in "abcdefg"], "id string")
    plain = W.siblings(tasks, edges, "child_of", "parent_of").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sibling").alias("first_sibling"))
    got = W.sibling_counts(tasks, edges, "child_of", "parent_of")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.id for r in got.collect()} == set("abcdg")


def test_combined_answers_a_class_once(spark, sf, monkeypatch):
    seen = []
    plain = RQ.R.combined
    monkeypatch.setattr(RQ.R, "combined", lambda docs, queries: seen.append(queries.count()) or plain(docs, queries))
    n = registry.queries()["K6_combined"](spark, sf).count()
    assert n and seen[0] < RQ.journal(spark, sf).filter("id % 100 = 0").count()
