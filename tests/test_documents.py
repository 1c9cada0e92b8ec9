"""Briefs, issue bodies, attachments, templates and small workflow operators on fixtures."""

from datetime import date

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import documents as D
from quillgraph.operators import graph as G
from quillgraph.operators import journal as J
from quillgraph.operators import maintain as M
from quillgraph.operators import reports as P
from quillgraph.operators import workflow as W

NODES = [
    ("epic-1", "epic", "active", "Slice", "# Slice\n\nThe core loop."),
    ("feat-1", "feature", "active", "Chain", "# Chain\n\nWagons with\nsprings.\n\nMore."),
    ("task-1", "task", "in_progress", "Physics", "# Physics\n\n## Deliverables\n- a\n- b\n- c\n- d\n\n## Notes\nx"),
    ("task-2", "task", "done", "Joints", "# Joints\n\nTune."),
    ("task-3", "task", "backlog", "Plain", "# Plain\n\nJust do it."),
    ("dec-1", "decision", "discussing", "Joint type", "# Joint type\n\nSpherical."),
    ("dec-2", "decision", "rejected", "Old", "# Old\n\nNo."),
    ("risk-1", "risk", "identified", "Jitter", "# Jitter\n\nMay explode."),
    ("q-1", "open_question", None, "Mass", "# Mass\n\nHow heavy?"),
    ("comp-1", "component", "active", "Engine", "# Engine\n\nRigid bodies."),
]
EDGES = [("feat-1", "child_of", "epic-1"), ("task-1", "child_of", "feat-1"), ("task-2", "child_of", "feat-1"), ("task-3", "child_of", "feat-1"), ("feat-1", "decomposes_to", "task-1"), ("feat-1", "decomposes_to", "task-2"), ("feat-1", "decomposes_to", "task-3"), ("feat-1", "depends_on", "dec-1"), ("feat-1", "depends_on", "dec-2"), ("feat-1", "has_risk", "risk-1"), ("task-1", "has_question", "q-1"), ("task-1", "uses", "comp-1"), ("task-3", "blocked_by", "task-1")]


def graph(spark):
    n = spark.createDataFrame(NODES, "id string, node_type string, status string, title string, body string")
    e = spark.createDataFrame([(a, k, b, t, None, None) for k, (a, t, b) in enumerate(EDGES)], "source_id string, edge_idx int, target_id string, edge_type string, valid_from date, valid_until date")
    return n, e


def test_brief_has_ten_sections(spark):
    n, e = graph(spark)
    roots = spark.createDataFrame([("task-1",), ("task-3",), ("task-1",)], "root_id string")
    rows = {(r.root_id, r.ordinal): (r.heading, r.body) for r in D.briefs(roots, n, e).collect()}
    assert {k for r, k in rows if r == "task-1"} == {1, 2, 3, 4, 5, 7, 8, 9, 10} and {k for r, k in rows if r == "task-3"} == {1, 2, 3, 4, 5, 6, 8, 9, 10}
    assert rows["task-1", 1] == ("Physics", "Task task-1, in_progress\nScope: Slice > Chain")
    assert rows["task-1", 2][1] == rows["task-3", 2][1] == D.WORDING["complex"]
    assert rows["task-1", 3] == ("Deliverables", "- a\n- b\n- c\n- d") and rows["task-3", 3] == ("Objective", "Just do it.")
    assert rows["task-1", 4][1] == "### Joint type (under discussion)\nSpherical.\n### Leave alone: Joints\n"
    assert rows["task-1", 5][1].startswith("### Chain (active)\nWagons with") and rows["task-3", 6][1] == "- [~] Physics (task-1)"
    assert rows["task-1", 8][1] == "- Risk: Jitter: May explode.\n- Open question: Mass: How heavy?"
    assert rows["task-1", 9][1] == "- [x] Joints (task-2)\n- [ ] Plain (task-3)"
    document = {r.root_id: r.document for r in D.brief_documents(D.briefs(roots, n, e)).collect()}
    assert document["task-1"].startswith("# Physics\n\nTask task-1") and document["task-3"].count("\n## ") == 8
    assert D.briefs(roots.limit(0), n, e).count() == 0


def test_issue_bodies_and_attachments(spark):
    n, e = graph(spark)
    got = {r.root_id: r.body for r in D.issue_bodies(spark.createDataFrame([("feat-1",), ("q-1",)], "root_id string"), n, e).collect()}
    assert got["q-1"] == "How heavy?" and "<details><summary>Parents</summary>\n\n- **Slice** (active): The core loop.\n</details>" in got["feat-1"]
    assert got["feat-1"].index("Decisions") < got["feat-1"].index("Risks") and got["feat-1"].startswith("Wagons with\nsprings.")
    a = {(r.source_id, r.title): r for r in D.attachments(n, e).collect()}
    assert set(a) == {("feat-1", "Joint type"), ("feat-1", "Old"), ("feat-1", "Jitter"), ("task-1", "Mass"), ("task-1", "Engine")}
    assert a["task-1", "Mass"].subtitle == "open_question (—) — How heavy?" and '"edgeType":"has_question"' in a["task-1", "Mass"].metadata


def test_sections_in_three_modes(spark):
    n = spark.createDataFrame([("r", "feature", "active", "R"), ("a", "component", "active", "A"), ("b", "component", "superseded", "B")], "id string, node_type string, status string, title string")
    e = spark.createDataFrame([("r", 0, "a", "uses", None, date(2024, 1, 1)), ("r", 1, "b", "uses", None, None)], "source_id string, edge_idx int, target_id string, edge_type string, valid_from date, valid_until date")
    s = spark.createDataFrame([(0, "C", "uses", "component", [])], "ordinal int, heading string, edge_type string, target_type string, statuses array<string>")
    roots = spark.createDataFrame([("r", date(2023, 1, 1))], "root_id string, day date")
    assert {m: {r.target_id for r in D.sections_at(roots, s, e, n, m).collect()} for m in ("as_of", "current", "history")} == {"as_of": {"a"}, "current": set(), "history": {"a", "b"}}
    two = spark.createDataFrame([("t", 1), ("u", 2)], "template string, ordinal int")
    own = spark.createDataFrame([("t", 9)], "template string, ordinal int")
    assert {tuple(r) for r in D.templates(two, own).collect()} == {("t", 9), ("u", 2)}
    assert {tuple(r) for r in D.with_overrides(two, own, ["template"]).collect()} == {("t", 9), ("u", 2)}


def test_text_and_entries(spark):
    one = lambda expr, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(expr.alias("x")).first().x
    assert one(T.slug_words(F.col("t")), t="# Été à Paris!\nmore") == "été-à-paris" and one(T.slug_words(F.col("t")), t=" ") == "untitled"
    assert one(T.typed_slug(F.col("t"), F.col("k")), t="Session replay: " + "word " * 20, k="feature") == "feat-session-replay-word-word-word-word-word-word-word"[: len("feat-") + 49].rsplit("-", 1)[0] + "-word"
    assert one(T.nearest_kind(F.col("k"), aliases={"adr": "decision"}), k=" ADR ") == "decision"
    assert "P99" in one(T.suggested_angle(F.lit("missing_constraint"), F.col("b")), b="Need FAST answers") and one(T.suggested_angle(F.lit("none"), F.col("b")), b="x") is None
    e = spark.createDataFrame([("a", "decision", "x", None), ("b", "decision", " ", "r"), ("c", "plan", None, None), ("d", "assumption", None, None)], "id string, kind string, chosen string, rationale string")
    assert {r.id: r.m for r in e.select("id", J.missing_field(e).alias("m")).collect()} == {"a": "missing_rationale", "b": "missing_chosen", "c": None, "d": "missing_polarity"}


def test_ids_links_and_stores(spark):
    n = spark.createDataFrame([("feat-chain-0a1b2c", "features/chain.md", "feature"), ("p-7", "p-7.md", "persona"), ("q-7", "q-7.md", "task")], "id string, file_path string, node_type string")
    asked = spark.createDataFrame([("chain",), ("features/chain.md",), ("0a1b2c",), ("p-7",), ("7",), ("zz",)], "query string")
    assert {r.query: (r.id, r.outcome) for r in G.resolve(asked, n).collect()} == {"chain": ("feat-chain-0a1b2c", "found"), "features/chain.md": ("feat-chain-0a1b2c", "found"), "0a1b2c": ("feat-chain-0a1b2c", "found"), "p-7": ("p-7", "found"), "7": (None, "ambiguous"), "zz": (None, "none")}
    state = spark.createDataFrame([("q-7", "L-1"), ("x", "L-2")], "node_id string, linear_id string")
    want = spark.createDataFrame([("q-7", "L-1"), ("q-7", "L-3"), ("feat-chain-0a1b2c", "L-2"), ("feat-chain-0a1b2c", "L-9"), ("p-7", "L-8"), ("none", "L-8")], "id string, linear_id string")
    assert sorted(r.outcome for r in W.linked(n, state, want).collect()) == ["linked", "no_node", "relinked", "taken", "unchanged", "wrong_type"]
    assert W.unlinked(state, want).count() == 1
    plan = {r.old_id: (r.new_id, r.outcome) for r in M.suffix_plan(spark.createDataFrame([("feature-a",), ("feature-b-abcdef",), ("feature-c-0abcde",)], "id string"), ["feature"]).collect()}
    assert plan["feature-b-abcdef"] == (None, "look_alike") and "feature-c-0abcde" not in plan and plan["feature-a"][0].startswith("a-")
    assert {r.state: r.s for r in spark.createDataFrame([("Triage",), ("Done",), ("?",)], "state string").select("state", P.local_status(F.lit("feature"), F.col("state")).alias("s")).collect()} == {"Triage": "draft", "Done": "completed", "?": None}


def test_semantic_sections_by_a_provider(spark):
    n, e = graph(spark)
    v = spark.createDataFrame([("task-1", "task", [1.0, 0.0]), ("task-2", "task", [0.9, 0.1]), ("task-3", "task", [0.0, 1.0]), ("dec-1", "decision", [1.0, 0.0])], "id string, node_type string, embedding array<double>")
    roots = spark.createDataFrame([("task-1",)], "root_id string")
    got = D.semantic_items(D.VectorProvider(v), roots, n, 7, "Similar", 1).collect()
    assert [(r.root_id, r.ordinal, r.target_id, r.item_title) for r in got] == [("task-1", 7, "task-2", "Joints")]

    class Fixed:
        def similar(self, roots, k):
            return roots.select(F.col("root_id").alias("query_id"), F.lit("comp-1").alias("id"), F.lit(1).alias("rank"))

    assert D.semantic_items(Fixed(), roots, n, 1, "H").first().item_title == "Engine"


def test_publishing_flushes_at_the_end(spark, tmp_path):
    import json
    import time

    from quillgraph.streaming import journal as SJ

    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda k: json.dumps({"id": f"e{k}", "ts": "2024-01-01T00:00:00Z", "agent": "a", "kind": "finding", "summary": f"a summary that is long enough {k}", "session_id": "s"}) + "\n"
    (folder / "1.json").write_text(row(1))
    out = str(tmp_path / "out")
    finish = SJ.publish(SJ.tail(spark, str(folder)), out, str(tmp_path / "bad"), str(tmp_path / "cp"), "1 hour")
    for _ in range(120):
        if (tmp_path / "out" / "batch=0" / "_SUCCESS").exists() and (tmp_path / "bad" / "batch=0" / "_SUCCESS").exists():
            break
        time.sleep(0.5)
    (folder / "2.json").write_text(row(2))
    finish()
    assert {r.id for r in spark.read.parquet(out).collect()} == {"e1", "e2"}


def test_briefs_deal_a_hop_by_root_once(spark):
    """No exchange by root and target beside the one by root, and blockers are looked for once."""
    import re

    from quillgraph.operators import documents as D

    nodes = spark.createDataFrame([("t", "task", "One", "active", "# One"), ("u", "task", "Two", "done", "# Two"), ("f", "feature", "F", "active", "# F\n\nLead")], "id string, node_type string, title string, status string, body string")
    edges = spark.createDataFrame([("t", 0, "f", "child_of"), ("f", 0, "t", "decomposes_to"), ("f", 1, "u", "decomposes_to"), ("f", 2, "u", "decomposes_to"), ("t", 1, "u", "blocked_by"), ("t", 2, "gone", "blocked_by")], "source_id string, edge_idx int, target_id string, edge_type string")
    out = D.briefs(spark.createDataFrame([("t",)], "root_id string"), nodes, edges)
    assert {r.ordinal: r.body for r in out.collect()} == {
        1: "Task t, active\nScope: F", 2: D.WORDING["complex"], 4: "### Leave alone: Two\n", 5: "### F (active)\nLead", 6: "- [x] Two (u)", 9: "- [x] Two (u)", 10: D.WORDING["done"],
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(root_id#\d+, target_id#\d+", plan)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("= blocked_by") <= 1
