"""The k-d tree against a plain one, and its rule for equal texts."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import kdshard


def plain_tree(x, size, shards):
    """Recursive splits at weighted quantiles along the widest axis, on all rows in memory."""
    out = np.zeros(len(size), int)

    def split(rows, first, n):
        if n == 1:
            out[rows] = first
            return
        spread = x[rows].astype(float).std(axis=0)
        axis = int(np.argmax(spread))
        order = rows[np.argsort(x[rows, axis], kind="stable")]
        values, start = np.unique(x[order, axis], return_index=True)
        upto = np.cumsum(np.add.reduceat(size[order], start))
        target = upto[-1] * (n // 2) / n
        k = int(np.searchsorted(upto, target, "left"))
        before = upto[k - 1] if k else 0
        k += 2 * (target - before) >= upto[k] - before  # the value that the target falls in goes where it misses less
        cut = values[k] if k < len(values) else values[-1] + 1
        low = x[rows, axis] < cut
        split(rows[low], first, n // 2)
        split(rows[~low], first + n // 2, n - n // 2)

    split(np.arange(len(size)), 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_leaves_equal_a_plain_tree(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, _ = kdshard._points(docs, "doc_id", "text", ("source", "lang", "n_chars"))
    got = rows.select("id", "size", "x", kdshard.number_of(kdshard.tree(rows, shards, 3), F.col("x")).alias("shard")).collect()
    want = plain_tree(np.array([r.x for r in got]), np.array([r["size"] for r in got]), shards)
    assert [r.shard for r in got] == list(want)


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_stage_and_query_have_one_rule(spark, monkeypatch, few):
    monkeypatch.setattr(kdshard, "BROADCAST_GROUPS", few)
    rows = [(k, f"text {k // 3} " + "w " * (k % 40), f"s{k % 5}", "en", k % 40) for k in range(900)] + [(k, "hot text", f"s{k % 7}", "de", 8) for k in range(900, 1500)] + [(-1, None, None, None, None), (-1, None, None, None, None), (-2, "x" * 300_000, "s1", "en", 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("h", F.lit(1)).withColumn("least", F.lit("clash"))
    stage = {r.doc_id: r.shard for r in kdshard.shard_docs(d, 9).collect()}
    query = {r.id: r.shard for r in kdshard.assign(d, 9).collect()}
    assert stage == query and kdshard.shard_docs(d, 9).columns == [*d.columns, "shard"] and kdshard.shard_docs(d, 9).count() == len(rows)
    homes = defaultdict(set)
    for k, t, *_ in rows:
        homes[t].add(stage[k])
    assert sum(len(s) > 1 for s in homes.values()) <= 8  # no more groups than cuts are parted
    assert kdshard.shard_docs(d.limit(0), 4).count() == 0
