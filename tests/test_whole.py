"""Whole results of queries, each on a case that a cut would lose."""

import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import journal as J
from quillgraph.operators import search as SR
from quillgraph.plans import registry
from tests import test_oracle

duck = test_oracle.duck


def test_typed_neighbours_beyond_the_nearest_of_all_types(spark):
    rows = [(k, k % 5, [1.0, k / 100]) for k in range(200)] + [(500, None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, node_type long, embedding array<double>")
    q = v.filter("id = 0 or id = 500").withColumnRenamed("id", "query_id")
    got = [r.id for r in SR.nearest(v, q, 31, within="node_type").orderBy("rank").collect()]
    assert got == list(range(0, 155, 5))


def test_typed_section_is_whole(spark, sf):
    of_type = Counter(r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    kind = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = Counter(r.query_id for r in registry.queries()["R5_typed_section"](spark, sf).collect())
    assert got == {i: n for i, t in kind.items() if i % 100 == 0 and (n := min(30, of_type[t] - 1))}


def test_typed_section_twin(spark, sf, duck):
    test_oracle.test_same_rows(spark, sf, duck, "R5_typed_section")
    test_oracle.test_same_rows(spark, sf, duck, "P13_whole_titles")


def test_digests_look_past_repeats(spark):
    at = datetime(2024, 1, 1)
    rows = [(f"e{k:03}", at - timedelta(hours=k), "same" if k < 60 else f"other {k}", "x" * 40, "finding", "h", ["hot"]) for k in range(300)]
    e = spark.createDataFrame(rows, "id string, ts timestamp, summary string, detail string, kind string, head string, files array<string>")
    now = F.lit("2024-01-02").cast("timestamp")
    got = J.path_digest(e, spark.createDataFrame([("hot",)], "path string"), now).collect()
    assert sorted(r.id for r in got) == ["e000"] + [f"e{k:03}" for k in range(60, 109)]
    c = spark.createDataFrame([("r", "h")], "range_id string, sha string")
    assert J.range_digest(e, c, now).count() == 50
    # 2 + 11 tokens, 3 + 11, and 3 for a third summary without its detail
    assert sorted((r.id, r.detail is None) for r in J.range_digest(e, c, now, budget=30).collect()) == [("e000", False), ("e060", False), ("e061", True)]
    assert J.by_commits(e, c, now).count() == 1


def test_hot_paths_have_digests(spark, sf):
    paths = {r.path for r in registry.queries()["K13_path_digest"](spark, sf).select("path").distinct().collect()}
    assert {"src/g0.py", "src/g1.py", "src/g2.py"} <= paths


def test_whole_phrases(spark, sf):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    title = {i: words(t.split("\n")[0]) for i, t in docs.items()}
    joined = {i: " " + "  ".join(title[i] + words(t)) + " " for i, t in docs.items()}
    want = {(q, i) for q, p in title.items() if q % 100 == 0 and p for i, x in joined.items() if " " + "  ".join(p) + " " in x}
    got = registry.queries()["K6_whole_phrases"](spark, sf).collect()
    assert {(r.query_id, r.id) for r in got} == want and any(len(title[q]) > 2 for q, _ in want)


def test_body_summary_takes_the_first_paragraph(spark):
    cases = [("# Title\n\n## More\nfirst line\nsecond line\n\nother", "first line second line"), (None, ""), ("# only", ""), ("a\r\nb", "a b"), ("  lead\n \t\nx", "  lead"), ("one two three four five six seven eight nine ten", "one two three four five six seven eight..."), ("y" * 50, "y" * 40 + "...")]
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.s for r in d.select("k", T.body_summary(F.col("t"), 40).alias("s")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(cases)}
