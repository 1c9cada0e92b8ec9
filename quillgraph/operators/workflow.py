"""Interviews, sync planning, publishing and document assembly for all sessions, issues or roots at once
(G1-G9, G16, G17, J21-J24, A15-A18, O9, O10, W7, W8, W10, R1-R4, R7, R8, S12, S16, S19, E1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.plans.lineage import checkpoint

#: What a missing edge of a root means: edge, target, gap type, priority (0 required, 1 recommended, 2 nice to have), phase.
GAP_CLASSES = [
    ("serves", "persona", "missing_persona", 0, 1),
    ("measured_by", "metric", "missing_success_metric", 0, 1),
    ("constrained_by", "constraint", "missing_constraint", 1, 1),
    ("has_risk", "risk", "missing_risk", 1, 1),
    ("depends_on", "decision", "no_technical_decision", 0, 2),
    ("uses", "component", "missing_component", 1, 2),
    ("exposes", "api_surface", "missing_api_surface", 2, 2),
    ("decomposes_to", "task", "no_task_decomposition", 0, 3),
    ("has_question", "open_question", "unresolved_question", 2, 3),
]
PHASES = ("discovery", "product", "technical", "decomposition", "review")


def ready_nodes(tentative: DataFrame) -> DataFrame:
    """Tentative nodes (session_id, id, node_type, body) without a "needs:" line."""
    return tentative.filter(~T.needs_marker(F.col("body")))


def ready_edges(edges: DataFrame, tentative: DataFrame) -> DataFrame:
    """Edges from the root whose target is ready."""
    return edges.join(ready_nodes(tentative).select("session_id", F.col("id").alias("target_id")), ["session_id", "target_id"], "left_semi")


def gaps(sessions: DataFrame, allowed: DataFrame, tentative: DataFrame, edges: DataFrame) -> DataFrame:
    """Open gaps of each session (session_id, gap_type, node_type, edge_type, priority, phase, pos).

    ``sessions``: session_id, root_type, body. A blank body or one under 30 bytes is a gap; so is
    each allowed edge of the root's type that neither a ready edge nor a ready node covers. Sorted by
    phase, priority and schema order; of neighbours alike in type and node type the first stays."""
    spark = sessions.sparkSession
    classes = spark.createDataFrame(GAP_CLASSES, "edge_type string, target_type string, gap_type string, priority int, phase int")
    rules = allowed.join(classes, ["edge_type", "target_type"], "left").select("source_type", "edge_type", "target_type", "ordinal", F.coalesce("gap_type", F.lit("missing_dependency")).alias("gap_type"), F.coalesce("priority", F.lit(2)).alias("priority"), F.coalesce("phase", F.lit(2)).alias("phase"))
    wanted = sessions.select("session_id", F.col("root_type").alias("source_type")).join(rules, "source_type")
    by_edge = ready_edges(edges, tentative).select("session_id", "edge_type").distinct()
    by_node = ready_nodes(tentative).select("session_id", F.col("node_type").alias("target_type")).distinct()
    open_ = wanted.join(by_edge, ["session_id", "edge_type"], "left_anti").join(by_node, ["session_id", "target_type"], "left_anti")
    found = open_.select("session_id", "gap_type", F.col("target_type").alias("node_type"), "edge_type", "priority", "phase", "ordinal")
    body = F.coalesce(F.col("body"), F.lit(""))
    short = sessions.filter((F.trim(body) == "") | (F.octet_length(body) < 30)).select("session_id", F.lit("problem_statement").alias("gap_type"), F.col("root_type").alias("node_type"), F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("priority"), F.lit(0).alias("phase"), F.lit(-1).alias("ordinal"))
    w = Window.partitionBy("session_id").orderBy("phase", "priority", "ordinal")
    whole = found.unionByName(short)
    same = (F.lag("gap_type").over(w) == F.col("gap_type")) & (F.lag("node_type").over(w) == F.col("node_type"))
    return whole.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").withColumn("pos", F.row_number().over(w)).drop("_same", "ordinal")


def question_types(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closed for one existing node of the type, a forced choice for several, else by priority."""
    existing = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    kind = F.when(n == 1, "closed").when(n > 1, "forced_choice").when(F.col("priority") == 1, "implication").otherwise("open")
    return found.join(existing, "node_type", "left").withColumn("question_type", kind).drop("n")


def next_questions(found: DataFrame, sessions: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` gaps whose phase is not after the session's."""
    now = sessions.select("session_id", F.col("phase").alias("_phase"))
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return found.join(now, "session_id").filter("phase <= _phase").withColumn("rn", rn).filter(F.col("rn") <= n).drop("_phase")


def phase_moves(sessions: DataFrame, answers: DataFrame, tentative: DataFrame, edges: DataFrame) -> DataFrame:
    """Each session's answers in its phase and the phase it moves to (null: stays).

    ``sessions``: session_id, phase, body; ``answers``: session_id, phase, a row for each answer."""
    count = answers.groupBy("session_id", "phase").agg(F.count(F.lit(1)).alias("n"))
    types = ready_nodes(tentative).groupBy("session_id").agg(F.collect_set("node_type").alias("types"))
    kinds = ready_edges(edges, tentative).groupBy("session_id").agg(F.collect_set("edge_type").alias("kinds"))
    x = sessions.join(count, ["session_id", "phase"], "left").join(types, "session_id", "left").join(kinds, "session_id", "left")
    has = lambda t, e: F.coalesce(F.array_contains("types", t), F.lit(False)) | F.coalesce(F.array_contains("kinds", e), F.lit(False))
    n = F.coalesce(F.col("n"), F.lit(0))
    ready = lambda ok, fallback: ((n >= 1) & ok) | (n >= fallback)
    product = has("persona", "serves") & has("metric", "measured_by") & (F.octet_length(F.coalesce("body", F.lit(""))) > 50)
    technical = has("component", "uses") | has("decision", "depends_on")
    moves = F.when(F.col("phase") == 0, ready(F.lit(True), 1)).when(F.col("phase") == 1, ready(product, 4)).when(F.col("phase") == 2, ready(technical, 3)).when(F.col("phase") == 3, ready(has("task", "decomposes_to"), 2)).otherwise(F.lit(False))
    return x.select("session_id", "phase", n.cast("long").alias("n_answers"), F.when(moves, F.col("phase") + 1).alias("next_phase"))


def commit_plan(tentative: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, kind, key, outcome): nodes to create, edges to write, edges skipped for a missing end."""
    known = tentative.select("session_id", "id").withColumn("_in", F.lit(True))
    graph = nodes.select("id").withColumn("_out", F.lit(True))
    end = lambda df, c: df.join(known.select("session_id", F.col("id").alias(c), F.col("_in").alias(f"{c}_in")), ["session_id", c], "left").join(graph.select(F.col("id").alias(c), F.col("_out").alias(f"{c}_out")), c, "left")
    e = end(edges, "target_id").withColumn("ok", F.coalesce("target_id_in", "target_id_out", F.lit(False)))
    created = tentative.select("session_id", F.lit("node").alias("kind"), F.col("id").alias("key"), F.lit("created").alias("outcome"))
    return created.unionByName(e.select("session_id", F.lit("edge").alias("kind"), F.concat_ws(" ", "edge_type", "target_id").alias("key"), F.when(F.col("ok"), "written").otherwise("skipped").alias("outcome")))


def last_wins(log: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The latest row of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in at]))
    return log.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


SYNCED = {"epic": 0, "feature": 1, "task": 2}


def push_plan(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """(id, action, ord) of syncable nodes: create without state, update when the content
    changed; an unchanged epic counts as updated, an unchanged issue is skipped."""
    s = state.select(F.col("node_id").alias("id"), "linear_id", "hash_at_sync")
    order = F.coalesce(*[F.when(F.col("node_type") == t, k) for t, k in SYNCED.items()])
    x = nodes.filter(F.col("node_type").isin(*SYNCED)).join(s, "id", "left")
    same = F.col("content_hash") == F.col("hash_at_sync")
    action = F.when(F.col("linear_id").isNull(), "create").when(same & (F.col("node_type") != "epic"), "skip").otherwise("update")
    return x.select("id", "linear_id", action.alias("action"), order.alias("ord"))


def sync_status(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Counts of linked, unlinked, stale and orphaned."""
    s = state.select(F.col("node_id").alias("id"), "hash_at_sync")
    x = nodes.select("id", "node_type", "content_hash").join(s, "id", "full_outer")
    linked = F.col("node_type").isNotNull() & F.col("hash_at_sync").isNotNull()
    return x.agg(
        F.count_if(linked).alias("linked"),
        F.count_if(F.col("node_type").isin(*SYNCED) & F.col("hash_at_sync").isNull()).alias("unlinked"),
        F.count_if(linked & (F.col("content_hash") != F.col("hash_at_sync"))).alias("stale"),
        F.count_if(F.col("node_type").isNull()).alias("orphaned"),
    )


def pull_plan(issues: DataFrame, state: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_id, action) of remote issues (id, updated_at, archived, status, parent).

    In this order: unchanged, conflict (the local node changed too), archived, status change,
    touched; untracked issues are imported if their parent is tracked, else ignored."""
    s = state.select(F.col("linear_id").alias("id"), "node_id", "hash_at_sync", F.col("updated_at").alias("synced_at"))
    n = nodes.select(F.col("id").alias("node_id"), "content_hash", F.col("status").alias("local_status"))
    parents = state.select(F.col("linear_id").alias("parent"), F.lit(True).alias("parent_tracked"))
    x = issues.join(s, "id", "left").join(n, "node_id", "left").join(parents, "parent", "left")
    tracked = F.when(F.col("updated_at") <= F.col("synced_at"), "unchanged").when(F.col("content_hash") != F.col("hash_at_sync"), "conflict").when(F.col("archived"), "archived").when(F.col("remote_status").isNotNull() & ~F.col("remote_status").eqNullSafe(F.col("local_status")), "status_change").otherwise("touched")
    action = F.when(F.col("node_id").isNotNull(), tracked).when(F.col("parent_tracked"), "import").otherwise("ignore")
    return x.select("id", "node_id", action.alias("action"))


def upsert(state: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``fresh`` rows replace those of the same key."""
    return state.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both sources, distinct by key; a row of the first wins."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def retention(snapshots: DataFrame, keep_recent: int, cap: int) -> DataFrame:
    """Why each snapshot (snapshot_key, bytes, modified, pinned) stays, or 'evict'.

    Pinned ones stay, then the newest ``keep_recent`` of the rest, then, newest first, each that
    still fits under ``cap``; one that does not fit is passed over. The list of one store's
    snapshots folds in one row."""
    row = "array<struct<key:string,reason:string>>"

    def step(a: Column, x: Column) -> Column:
        recent = ~x["pinned"] & (a["n"] < keep_recent)
        fits = a["used"] + x["bytes"] <= cap
        reason = F.when(x["pinned"], "pinned").when(recent, "recent").when(fits, "under_cap").otherwise("evict")
        counted = ~x["pinned"] & ~recent & fits
        return F.struct((a["n"] + recent.cast("int")).alias("n"), F.when(counted, a["used"] + x["bytes"]).otherwise(a["used"]).alias("used"), F.concat(a["out"], F.array(F.struct(x["key"].alias("key"), reason.alias("reason")))).alias("out"))

    listed = snapshots.agg(F.sort_array(F.collect_list(F.struct("modified", F.col("snapshot_key").alias("key"), "bytes", "pinned")), asc=False).alias("s"))
    rest = F.filter("s", lambda x: ~x["pinned"])
    kept = F.aggregate(F.concat(F.filter("s", lambda x: x["pinned"]), F.slice(rest, 1, keep_recent)), F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    start = F.struct(F.lit(0).alias("n"), kept.alias("used"), F.array().cast(row).alias("out"))
    return listed.select(F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("r")).select(F.col("r.key").alias("snapshot_key"), "r.reason")


def snapshot_key(files: DataFrame) -> DataFrame:
    """One hash over (label, content) of all files, whatever their order: hashes of buckets of
    sorted file hashes, so no task holds them all. A bucket is the first 4 hexadecimal digits of the file hash."""
    own = F.sha2(F.concat_ws("\u0001", "label", F.sha2("content", 256)), 256)
    hashed = files.select(own.alias("h")).withColumn("b", F.left("h", F.lit(4)))
    part = hashed.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256), 1, 16).alias("snapshot_key"), F.sum("n").alias("n_files"))


def pruned(snapshots: DataFrame, keep_recent: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, keys that go) under the retention of W8; deleting the files is the caller's."""
    why = retention(snapshots, keep_recent, cap)
    return snapshots.join(why.filter("reason <> 'evict'").select("snapshot_key"), "snapshot_key", "left_semi"), why.filter("reason = 'evict'").select("snapshot_key")


def rebuilt(entries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A journal index built anew from ``entries`` (of one id the first by ts), beside the vectors, which are
    kept whole: contents that come back find theirs."""
    first = Window.partitionBy("id").orderBy("ts")
    return entries.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), vectors


def linked(nodes: DataFrame, state: DataFrame, asked: DataFrame) -> DataFrame:
    """Link requests (id, linear_id) with the outcome of each: 'no_node', 'wrong_type' (only epics, features and
    tasks can be linked), 'taken' (another node has the issue), 'unchanged', 'relinked' or 'linked'."""
    own = state.select(F.col("node_id").alias("id"), F.col("linear_id").alias("_own"))
    other = state.select("linear_id", F.col("node_id").alias("_other"))
    x = asked.join(nodes.select("id", "node_type"), "id", "left").join(own, "id", "left").join(other, "linear_id", "left")
    outcome = F.when(F.col("node_type").isNull(), "no_node").when(~F.col("node_type").isin(*SYNCED), "wrong_type").when(F.col("_other").isNotNull() & (F.col("_other") != F.col("id")), "taken").when(F.col("_own") == F.col("linear_id"), "unchanged").when(F.col("_own").isNotNull(), "relinked").otherwise("linked")
    return x.select("id", "linear_id", outcome.alias("outcome"))


def unlinked(state: DataFrame, asked: DataFrame) -> DataFrame:
    """The sync state without the nodes of ``asked`` (id)."""
    return state.join(asked.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def push_targets(plan: DataFrame, nodes: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    """A push plan with the remote ``parent_id`` (of the first tracked parent that is a feature or task) and
    ``project_id`` (of the first tracked epic that the node or its parent belongs to)."""
    up = edges.filter("edge_type = 'child_of'").select(F.col("source_id").alias("id"), "target_id", "edge_idx")
    known = nodes.select(F.col("id").alias("target_id"), "node_type").join(state.select(F.col("node_id").alias("target_id"), "linear_id"), "target_id", "left")
    one = up.join(known, "target_id")
    two = one.filter("node_type = 'feature'").select("id", F.col("target_id").alias("_via"), F.col("edge_idx").alias("_first")).join(one.filter("node_type = 'epic'").select(F.col("id").alias("_via"), "linear_id", "edge_idx"), "_via")
    parent = one.filter("node_type in ('feature', 'task') and linear_id is not null").groupBy("id").agg(F.min_by("linear_id", "edge_idx").alias("parent_id"))
    near = one.filter("node_type = 'epic' and linear_id is not null").groupBy("id").agg(F.min_by("linear_id", "edge_idx").alias("_near"))
    far = two.filter("linear_id is not null").groupBy("id").agg(F.min_by("linear_id", F.struct("_first", "edge_idx")).alias("_far"))
    x = plan.join(parent, "id", "left").join(near, "id", "left").join(far, "id", "left")
    return x.withColumn("project_id", F.coalesce("_near", "_far")).drop("_near", "_far")


def publish_plan(sessions: DataFrame, archived: DataFrame) -> DataFrame:
    """Ready sessions in order of age, with 'published' or 'already_archived'."""
    there = archived.select("session_id").withColumn("_there", F.lit(True))
    x = sessions.join(there, "session_id", "left")
    return x.select("session_id", "ended", F.when(F.col("_there"), "already_archived").otherwise("published").alias("status"))


def packs(runs: DataFrame, every: int) -> DataFrame:
    """Running totals of published rows, and whether a run crosses a multiple of ``every``.

    Runs are dealt into ranges; totals run within a range, and the sums of the ranges before, a
    row each, are added."""
    ranged = checkpoint(runs.repartitionByRange("run").withColumn("_part", F.spark_partition_id()))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = ranged.groupBy("_part").agg(F.sum("n").alias("_sum")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("run")) + F.col("_before")
    return ranged.join(ahead, "_part").select("run", "n", upto.alias("total"), (F.floor((upto - F.col("n")) / every) < F.floor(upto / every)).alias("pack"))


def traverse_sections(roots: DataFrame, sections: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items of each (root_id, day) and section (ordinal, heading, edge_type, target_type,
    statuses), by as-of edges, in edge order."""
    valid = G.as_of_join(roots, edges).join(sections, "edge_type")
    n = nodes.filter(G.visible()).select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"), F.col("status").alias("item_status"), F.col("title").alias("item_title"))
    ok = F.col("item_status").isNull() | (F.size("statuses") == 0) | F.array_contains("statuses", F.col("item_status"))
    return valid.join(n, ["target_id", "target_type"]).filter(ok).select("root_id", "ordinal", "heading", "edge_idx", "target_id", "item_title", "item_status")


def render(roots: DataFrame, items: DataFrame, nodes: DataFrame) -> DataFrame:
    """One Markdown document for each root; a section without items is left out."""
    line = F.concat(F.lit("- "), F.col("item_title"), F.coalesce(F.concat(F.lit(" ("), F.col("item_status"), F.lit(")")), F.lit("")))
    section = items.groupBy("root_id", "ordinal", "heading").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("edge_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.col("body"))
    whole = section.groupBy("root_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("sections"))
    head = roots.select("root_id").distinct().join(nodes.select(F.col("id").alias("root_id"), "title", "status"), "root_id")
    title = F.concat(F.lit("# "), F.col("title"), F.coalesce(F.concat(F.lit("\nStatus: "), F.col("status")), F.lit("")))
    return head.join(whole, "root_id", "left").select("root_id", F.concat_ws("\n\n", title, "sections").alias("document"))


def siblings(tasks: DataFrame, edges: DataFrame, edge_type: str, reverse: str) -> DataFrame:
    """For each task (id) the other nodes that share a parent: two hops, distinct, without itself."""
    up = edges.filter(F.col("edge_type") == edge_type).select("source_id", F.col("target_id").alias("parent"))
    down = edges.filter(F.col("edge_type") == reverse).select(F.col("source_id").alias("parent"), F.col("target_id").alias("sibling"))
    return tasks.join(up, tasks["id"] == up["source_id"]).join(down, "parent").filter("sibling <> id").select("id", "sibling").distinct()


def sibling_counts(tasks: DataFrame, edges: DataFrame, edge_type: str, reverse: str) -> DataFrame:
    """J20 by classes: (id, n, first_sibling) of each task that has siblings: how many, and the least.

    Tasks under one parent share its children, so a parent is summed up once (its children's number and two least) and
    no pairs are made. Only a task of several parents, whose children may overlap, meets them one by one."""
    up = edges.filter(F.col("edge_type") == edge_type).select(F.col("source_id").alias("id"), F.col("target_id").alias("parent")).join(tasks.select("id").distinct(), "id", "left_semi").distinct()
    down = edges.filter(F.col("edge_type") == reverse).select(F.col("source_id").alias("parent"), F.col("target_id").alias("sibling")).distinct()
    least = down.groupBy("parent").agg(F.count(F.lit(1)).alias("c"), F.min("sibling").alias("a")).filter("a is not null")
    second = down.join(least.select("parent", "a"), "parent").filter("sibling <> a").groupBy("parent").agg(F.min("sibling").alias("b"))
    parents = least.join(second, "parent", "left")
    counted = up.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("parent").alias("parent"))
    own = down.select("parent", F.col("sibling").alias("id"), F.lit(1).alias("own"))
    n = F.col("c") - F.coalesce("own", F.lit(0))
    lone = counted.filter("k = 1").join(parents, "parent").join(own, ["parent", "id"], "left")
    lone = lone.select("id", n.alias("n"), F.when(F.col("a") == F.col("id"), F.col("b")).otherwise(F.col("a")).alias("first_sibling")).filter("n > 0")
    several = counted.filter("k > 1").select("id")
    pairs = up.join(several, "id", "left_semi").join(down, "parent").filter("sibling <> id").select("id", "sibling").distinct()
    return lone.unionByName(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("sibling").alias("first_sibling")))


def ancestors(nodes: DataFrame, edges: DataFrame, edge_type: str = "child_of") -> DataFrame:
    """The parent over the first edge of the type (by edge_idx), and the parent's parent."""
    first = edges.filter(F.col("edge_type") == edge_type).groupBy("source_id").agg(F.min_by("target_id", "edge_idx").alias("up"))
    one = nodes.join(first, nodes["id"] == first["source_id"]).select("id", F.col("up").alias("parent"))
    two = first.select(F.col("source_id").alias("parent"), F.col("up").alias("grandparent"))
    return one.join(two, "parent", "left").select("id", "parent", "grandparent")


def full_sync(nodes: DataFrame, issues: DataFrame, state: DataFrame) -> DataFrame:
    """One plan of (step, id, action): local changes go first, then remote ones that are not already pushed."""
    push = push_plan(nodes, state)
    pull = pull_plan(issues, state, nodes)
    sent = push.filter("action = 'update'").select(F.col("linear_id").alias("id"))
    return push.select(F.lit("push").alias("step"), "id", "action").unionByName(pull.join(sent, "id", "left_anti").select(F.lit("pull").alias("step"), "id", "action"))


def session_report(sessions: DataFrame, tentative: DataFrame, answers: DataFrame) -> DataFrame:
    """For each session and node type the node ids, how many still need work, and a preview of the first
    body's first three lines; with the number of answers."""
    needs = T.needs_marker(F.col("body"))
    preview = F.array_join(F.slice(F.split("body", "\n"), 1, 3), "\n")
    kinds = tentative.groupBy("session_id", "node_type").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count_if(needs).alias("n_needs"), F.min_by(preview, "id").alias("preview"))
    count = answers.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_answers"))
    return sessions.select("session_id", "phase").join(kinds, "session_id").join(count, "session_id", "left").select("session_id", "phase", "node_type", "ids", "n_needs", "preview", F.coalesce("n_answers", F.lit(0)).cast("long").alias("n_answers"))


def store_sizes(files: DataFrame) -> DataFrame:
    """Bytes, files and latest change of each snapshot (snapshot_key, length, modified)."""
    return files.groupBy("snapshot_key").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n_files"), F.max("modified").alias("modified"))


def needs_rebuild(stored: str | None, wanted: str) -> bool:
    """An index without a readable version, or of another one, is built anew."""
    return stored != wanted
