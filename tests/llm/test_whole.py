"""Whole results of the training-data operators, each on a case that a cut would lose."""

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import htmlpages, mixing


@pytest.mark.parametrize("budget", [0.3, 0.8, 1.0])
def test_a_rare_cell_does_not_thin_the_others(spark, budget):
    rows = [(k, "w " * (20 + k % 30), f"s{k % 3}", "en" if k % 4 else "de") for k in range(4000)] + [(9000, "w " * 5, "rare", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    expected = lambda got: got.agg(F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()[0]
    got = mixing.weigh(d, alpha=0.7, budget=budget).cache()
    assert expected(mixing.weigh(d, alpha=0.7)) < 0.2
    assert expected(got) == pytest.approx(budget, abs=1e-6)
    assert got.filter("id = 9000").first().probability == 1.0
    kept = got.filter("kept").agg(F.sum("tokens")).first()[0] / got.agg(F.sum("tokens")).first()[0]
    assert kept == pytest.approx(budget, abs=0.03)
    assert mixing.mix_docs(d, alpha=0.7, budget=budget).count() == got.filter("kept").count()
    assert mixing.weigh(d.limit(0), budget=budget).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pages_meet_their_neighbours_across_partitions(spark, parts):
    page = lambda k: f"<body><div>Acme daily</div><div>Section A</div><p>story {k}</p><div>All about Acme</div></body>"
    rows = [(k, f"http://h{k // 2:02}.com/{k % 2}" if k < 20 else f"http://z.com/{k:03}", page(k)) for k in range(60)]
    rows += [(None, "http://h00.com/9", page("last")), (99, None, page(99))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = htmlpages.extract(d).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text.pop(99) == "Acme daily Section A story 99 All about Acme" and text.pop(None) == "story last"
    assert text == {k: f"story {k}" for k in range(60)}
