"""Ranks of groups of any size: windows and ranges give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import journal as J
from quillgraph.operators import maintain as M
from quillgraph.operators import ranks as R


def table(spark):
    r = random.Random(2)
    rows = [("hub" if r.random() < 0.6 else r.choice(["a", "b", None]), k, r.choice([1, 2, None]), r.choice(["x", "y", None])) for k in range(400)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, at long, v long, s string").repartition(5)


@pytest.mark.parametrize("hub", [10, 1 << 20])
@pytest.mark.parametrize("down", [False, True])
def test_windows_and_ranges_agree(spark, hub, down, monkeypatch):
    monkeypatch.setattr(R, "HUB", hub)
    rows, df = table(spark)
    order = [F.desc("at") if down else F.asc("at")]
    want = {}
    for g in {x[0] for x in rows}:
        total, before = None, None
        for n, (_, at, v, s) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: -x[1] if down else x[1]), 1):
            total = total if v is None else (total or 0) + v
            want[at] = (n, total or 0, before)
            before = s
    n = {x.at: x.n for x in R.numbered(df, ["g"], order, "n").collect()}
    total = {x.at: x.t or 0 for x in R.running(df, ["g"], order, F.coalesce("v", F.lit(0)), "t").collect()}
    prior = {x.at: x.p for x in R.prior(df, ["g"], order, "s", "p").collect()}
    assert {at: (n[at], total[at], prior[at]) for at in n} == want and R.numbered(df, ["g"], order, "n").columns == [*df.columns, "n"]
    assert R.numbered(df.limit(0), ["g"], order, "n").count() == 0


def test_hubs_are_renumbered_and_followed_alike(spark, monkeypatch):
    e = spark.createDataFrame([("hub" if k % 3 else f"n{k}", 0, f"t{k * 7 % 100:03}", "uses", None, None) for k in range(100)], "source_id string, edge_idx int, target_id string, edge_type string, valid_from date, valid_until date")
    c = spark.createDataFrame([("k", f"{k:03}", "ab"[k // 3 % 2], k) for k in range(90)], "key string, at string, status string, tie int")
    plain = sorted(map(tuple, M.renumber(e).collect())), sorted(map(tuple, J.transitions(c, "key", "status", "at", "tie").collect()))
    monkeypatch.setattr(R, "HUB", 5)
    assert (sorted(map(tuple, M.renumber(e).collect())), sorted(map(tuple, J.transitions(c, "key", "status", "at", "tie").collect()))) == plain
    assert len(plain[1]) == 29


def test_roots_with_many_nodes_are_traversed_alike(spark, monkeypatch):
    r = random.Random(5)
    n = spark.createDataFrame([(f"n{k}",) for k in range(60)], "id string")
    e = spark.createDataFrame([(f"n{r.randrange(20)}", k, f"n{r.randrange(70)}", r.choice(["uses", "serves", "x"])) for k in range(400)], "source_id string, edge_idx int, target_id string, edge_type string")
    roots = spark.createDataFrame([("n0",), ("n1",), ("n0",), ("gone",), (None,)], "root_id string")
    for types in ((), ("serves", "uses")):
        plain = sorted(map(repr, G.bfs(roots, n, e, 3, types).collect()))
        with monkeypatch.context() as m:
            m.setattr(R, "HUB", 4)
            assert sorted(map(repr, G.bfs(roots, n, e, 3, types).collect())) == plain and len(plain) > 60
