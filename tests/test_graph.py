"""Graph operators on small fixtures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import maintain as M
from quillgraph.sources import bindings as B

EDGE = "source_id string, edge_idx int, target_id string, edge_type string, valid_from date, valid_until date"


def nodes(spark, *ids, **types):
    return spark.createDataFrame([(i, types.get(i, "feature"), "active", "o") for i in ids], "id string, node_type string, status string, owner string").withColumn("title", F.col("id"))


def edges(spark, *rows):
    full = [(s, k, t, e, *(dates or (None, None))) for k, (s, e, t, *rest) in enumerate(rows) for dates in [rest[0] if rest else None]]
    return spark.createDataFrame(full, EDGE)


def reach(spark, depth, e, root="a", types=()):
    ids = sorted({"a", "b", "c", "d"})
    got = G.bfs(spark.createDataFrame([(root,)], "root_id string"), nodes(spark, *ids), e, depth, types)
    return {r.id: (r.depth, r.path) for r in got.collect()}


def test_chain(spark):
    e = edges(spark, ("a", "depends_on", "b"), ("b", "depends_on", "c"))
    assert {k: d for k, (d, _) in reach(spark, 2, e).items()} == {"a": 0, "b": 1, "c": 2}
    assert set(reach(spark, 1, e)) == {"a", "b"}
    assert reach(spark, 2, e)["c"][1] == ["a", "b", "c"]
    assert reach(spark, 2, e, root="missing") == {}
    scored = G.scored(G.bfs(spark.createDataFrame([("a",)], "root_id string"), nodes(spark, "a", "b", "c"), e, 2))
    assert {r.id: r.score for r in scored.collect()} == {"a": 1.0, "b": 0.8, "c": 0.5}


def test_cycle_ends(spark):
    assert len(reach(spark, 10, edges(spark, ("a", "x", "b"), ("b", "x", "a")))) == 2


def test_edge_types_choose_and_order(spark):
    e = edges(spark, ("a", "depends_on", "b"), ("a", "serves", "c"), ("a", "uses", "d"))
    assert set(reach(spark, 2, e, types=("depends_on", "serves"))) == {"a", "b", "c"}
    assert len(reach(spark, 2, e)) == 4


@pytest.mark.parametrize(("day", "want"), [("2026-02-15", {"a", "c"}), ("2026-04-15", {"b", "c"}), ("2026-03-01", {"c"})])
def test_as_of_is_half_open(spark, day, want):
    e = edges(spark, ("s", "x", "a", (date(2026, 1, 15), date(2026, 3, 1))), ("s", "x", "b", (date(2026, 4, 1), None)), ("s", "x", "c"))
    assert {r.target_id for r in G.temporal(e, "as_of", F.lit(day).cast("date")).collect()} == want
    assert G.temporal(e, "history").count() == 3


def test_current_hides_future_ends(spark):
    e = edges(spark, ("s", "x", "a"), ("s", "x", "b", (date(2026, 1, 1), None)), ("s", "x", "c", (None, date(2999, 1, 1))))
    assert {r.target_id for r in G.temporal(e).collect()} == {"a", "b"}


def test_validate_finds_one_of_each(spark):
    n = spark.createDataFrame([("f", "feature", "banana", "o"), ("g", "feature", "draft", None), ("c", "component", "active", "o"), ("z", "made_up", "x", "o")], "id string, node_type string, status string, owner string")
    e = edges(spark, ("f", "uses", "c"), ("f", "uses", "gone"), ("c", "serves", "f"))
    got = {(r.kind, r.node_id) for r in M.validate(n, e, B.node_types(spark), B.allowed_edges(spark), B.edge_types(spark)).collect()}
    assert got == {("unknown_type", "z"), ("missing_field", "g"), ("bad_status", "f"), ("dangling_edge", "f"), ("disallowed_edge", "c"), ("missing_reverse", "f"), ("missing_reverse", "c")}


def test_repair_leaves_no_missing_reverse(spark):
    n = nodes(spark, "a", "b")
    e = edges(spark, ("a", "uses", "b"), ("a", "child_of", "b"))
    fixed = M.repair(n, e, B.edge_types(spark))
    assert fixed.count() == 4 and M.missing_reverse(n, fixed, B.edge_types(spark)).count() == 0


def test_incremental_equals_rebuild(spark):
    old = nodes(spark, "a", "b", "c").withColumn("index_hash", M.index_hash("id", "status"))
    new = nodes(spark, "b", "c", "d").withColumn("status", F.when(F.col("id") == "c", "draft").otherwise(F.col("status"))).withColumn("index_hash", M.index_hash("id", "status"))
    assert {r.id: r.action for r in M.index_changes(old, new).collect()} == {"a": "delete", "b": "keep", "c": "replace", "d": "insert"}
    assert {(r.id, r.index_hash) for r in M.apply_changes(old, new).collect()} == {(r.id, r.index_hash) for r in new.collect()}


def test_changes(spark):
    n, e = nodes(spark, "a", "b"), edges(spark, ("a", "uses", "b"), ("b", "used_by", "a"))
    assert M.remove_edges(e, e.limit(1), B.edge_types(spark)).count() == 0
    n2, e2 = M.rename(n, e, spark.createDataFrame([("b", "z")], "old_id string, new_id string"))
    assert {r.id for r in n2.collect()} == {"a", "z"} and {(r.source_id, r.target_id) for r in e2.collect()} == {("a", "z"), ("z", "a")}
    n3, e3 = M.delete_nodes(n, e, spark.createDataFrame([("b",)], "id string"))
    assert n3.count() == 1 and G.dangling(n3, e3).count() == 1


def test_traversal_deals_a_hop_once(spark, monkeypatch):
    """A hop is one exchange of what it meets, by root; the result is the same where hubs are numbered by ranges."""
    from quillgraph.operators import ranks

    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("d", "a"), ("a", "a"), ("b", "c"), ("e", "gone")]
    nodes = spark.createDataFrame([(i,) for i in "abcde"], "id string")
    edges = spark.createDataFrame([(s, t, "uses", i) for i, (s, t) in enumerate(pairs)], "source_id string, target_id string, edge_type string, edge_idx int")
    roots = spark.createDataFrame([("a",), ("c",), ("none",)], "root_id string")
    out = G.bfs(roots, nodes, edges, 2)
    rows = sorted((r.root_id, r.depth, r.pos, r.id, ">".join(r.path)) for r in out.collect())
    assert rows == [
        ("a", 0, 0, "a", "a"), ("a", 1, 1, "b", "a>b"), ("a", 1, 2, "c", "a>c"), ("a", 2, 1, "d", "a>b>d"), ("a", 2, 2, "e", "a>c>e"),
        ("c", 0, 0, "c", "c"), ("c", 1, 1, "d", "c>d"), ("c", 1, 2, "e", "c>e"), ("c", 2, 1, "a", "c>d>a"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "LeftAnti" not in plan
    monkeypatch.setattr(ranks, "HUB", 1)
    assert sorted((r.root_id, r.depth, r.pos, r.id, ">".join(r.path)) for r in G.bfs(roots, nodes, edges, 2).collect()) == rows


def test_missing_reverse_deals_edges_once(spark):
    """Loops, repeated edges, unknown types and absent targets, from one exchange of the edges."""
    rows = [("a", "uses", "b"), ("b", "used_by", "a"), ("a", "uses", "c"), ("a", "uses", "c"), ("c", "uses", "c"), ("d", "serves", "d"), ("d", "served_by", "d"), ("a", "odd", "b"), ("a", "uses", "gone"), ("c", "uses", "b"), ("b", "uses", "c"), ("a", "uses", None)]
    edges = spark.createDataFrame(rows, "source_id string, edge_type string, target_id string")
    nodes = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    out = M.missing_reverse(nodes, edges, B.edge_types(spark)).select("source_id", "edge_type", "target_id", "reverse")
    assert sorted(map(tuple, out.collect())) == sorted((s, "uses", t, "used_by") for s, t in (("a", "c"), ("a", "c"), ("c", "c"), ("c", "b"), ("b", "c")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "LeftAnti" not in plan


def test_candidates_are_dealt_as_lists(spark):
    """A hop's exchange by root has a row a list, not one a candidate, and no path where none is asked for."""
    n, e = nodes(spark, *"abcd"), edges(spark, ("a", "x", "b"), ("a", "x", "c"), ("a", "x", "d"))
    out = G.bfs(spark.createDataFrame([("a",)], "root_id string"), n, e, 1, paths=False)
    assert out.columns == ["root_id", "id", "depth", "pos"]
    assert [(r.id, r.pos) for r in out.orderBy("depth", "pos").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_COL" in line]
    assert dealt and all("SortAggregate" not in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())


def test_distances_equal_the_traversal(spark):
    """Nodes, depths and carried columns, also by way of a missing node, hubs of several lists and several edges between two nodes."""
    e = edges(spark, ("a", "x", "b"), ("a", "y", "b"), ("b", "x", "c"), ("c", "x", "a"), ("a", "x", "gone"), ("gone", "x", "d"), ("d", "x", "a"))
    n = nodes(spark, "a", "b", "c", "d", d="epic")
    roots = spark.createDataFrame([("a",), ("b",), ("d",), ("gone",), ("a",)], "root_id string")
    for depth in (0, 1, 2, 3):
        got = G.distances(roots, n, e, depth, ["node_type"])
        want = G.bfs(roots, n, e, depth, paths=False).join(n.select("id", "node_type"), "id")
        rows = lambda df: sorted(map(tuple, df.select("root_id", "id", "depth", "node_type").collect()))
        assert rows(got) == rows(want) and len(rows(want)) >= 3
    star = spark.range(3 * G.PACK).select(F.lit("h").alias("source_id"), F.concat(F.lit("t"), "id").alias("target_id"))
    far = star.select(F.col("target_id").alias("id")).unionByName(spark.createDataFrame([("h",)], "id string"))
    assert G.distances(spark.createDataFrame([("h",)], "root_id string"), far, star, 2).count() == 3 * G.PACK + 1


def test_reached_nodes_are_dealt_once(spark, sf):
    """K4 ranks what is reached where the last hop dealt it."""
    from quillgraph.operators import search as R

    n = spark.createDataFrame([(i, "x", None, 3, 0.0) for i in "abcd"], "id string, node_type string, updated timestamp, tokens long, boost double")
    e = edges(spark, ("a", "x", "b"), ("b", "x", "c"))
    hops = G.scored(G.distances(spark.createDataFrame([("a",)], "root_id string"), n, e, 1, ["boost", "tokens"])).withColumnRenamed("root_id", "query_id")
    words = spark.createDataFrame([("a", "b", 1.0), ("a", "d", 0.5)], "query_id string, id string, score double")
    out = R.hybrid(hops, words, None, n, F.current_timestamp())
    assert [(r.id, r.rank) for r in out.orderBy("rank").collect()] == [("b", 1), ("a", 2), ("d", 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    over = final[: final.index("Union")]
    assert "Exchange" not in over


def test_hops_look_at_edges_of_their_frontier(spark):
    """Edges of other nodes are left out before anything is dealt, and a root's candidates are not sorted as rows, with paths or without."""
    n = spark.range(400).select(F.concat(F.lit("n"), "id").alias("id"))
    e = spark.range(399).select(F.concat(F.lit("n"), "id").alias("source_id"), F.lit(0).alias("edge_idx"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_id"), F.lit("x").alias("edge_type"))
    kept = []

    def near(keep):
        kept.append(keep(e).count())
        return keep(e)

    for paths in (True, False):
        out = G.bfs(spark.createDataFrame([("n5",), ("n90",)], "root_id string"), n, near, 2, paths=paths)
        assert sorted((r.id, r.depth, r.pos) for r in out.collect()) == [("n5", 0, 0), ("n6", 1, 1), ("n7", 2, 1), ("n90", 0, 0), ("n91", 1, 1), ("n92", 2, 1)]
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 4 and all(2 <= k < 10 for k in kept)


def test_edges_are_validated_in_one_pass(spark, monkeypatch):
    """Loops, repeated edges, nodes of one id, ends that are missing, unknown types: as by the single checks, and no edge is written out."""
    n = spark.createDataFrame([("a", "feature"), ("b", "persona"), ("c", "component"), ("d", "odd"), ("e", "feature"), ("e", "persona"), ("f", None), ("g", "epic"), ("g", "epic")], "id string, node_type string").withColumns({"status": F.lit("active"), "owner": F.lit("o")})
    pairs = [(x, t, y) for x in ("a", "b", "d", "e", "f", "g", "gone", None) for y in ("a", "b", "c", "e", "f", "g", "lost", None) for k, t in enumerate(("serves", "served_by", "uses", "depends_on", "child_of", "what")) if (ord((x or "z")[0]) * 7 + ord((y or "y")[0]) * 3 + k * 5) % 4]
    e = spark.createDataFrame(pairs + pairs[::3], "source_id string, edge_type string, target_id string")
    schema = B.node_types(spark), B.allowed_edges(spark), B.edge_types(spark)
    want = [("dangling_edge", *r) for r in G.dangling(n, e).select("source_id", "edge_type", "target_id").collect()]
    want += [("disallowed_edge", *r) for r in M.disallowed(n, e, *schema).select("source_id", "edge_type", "target_id").collect()]
    want += [("missing_reverse", *r) for r in M.missing_reverse(n, e, schema[2]).select("source_id", "edge_type", "target_id").collect()]
    monkeypatch.setattr(M, "checkpoint", None)
    got = M.validate(n, e, *schema).filter("kind in ('dangling_edge', 'disallowed_edge', 'missing_reverse')")
    assert sorted((r.kind, str(r.node_id), str(r.detail)) for r in got.collect()) == sorted((k, str(s), "None" if None in (t, y) else f"{t} -> {y}") for k, s, t, y in want)
    assert len({k for k, *_ in want}) == 3


def test_modes_share_one_join(spark):
    """Items of all modes, each as :func:`sections_at` finds it, from one look at the edges."""
    from quillgraph.operators import documents as D

    day = lambda m: date(2026, m, 1)
    n = nodes(spark, "r", "a", "b", "c", a="persona", b="persona", c="persona").withColumn("status", F.when(F.col("id") == "c", "superseded").when(F.col("id") == "b", F.lit(None)).otherwise("active"))
    e = edges(spark, ("r", "serves", "a", (day(1), day(3))), ("r", "serves", "b", (day(1), None)), ("r", "serves", "c"), ("r", "uses", "a"), ("r", "serves", "gone"))
    sections = spark.createDataFrame([(0, "P", "serves", "persona", []), (1, "Q", "serves", "persona", ["superseded"])], "ordinal int, heading string, edge_type string, target_type string, statuses array<string>")
    roots = spark.createDataFrame([("r", day(4))], "root_id string, day date")
    got = D.sections_of_modes(roots, sections, e, n)
    rows = {m: sorted((r.ordinal, r.target_id) for r in got.filter(m if m != "history" else "true").collect()) for m in ("as_of", "current", "history")}
    for m, found in rows.items():
        assert found == sorted((r.ordinal, r.target_id) for r in D.sections_at(roots, sections, e, n, m).collect())
    assert rows == {"as_of": [(0, "b"), (1, "b")], "current": [(0, "b"), (1, "b")], "history": [(0, "a"), (0, "b"), (0, "c"), (1, "b"), (1, "c")]}
