"""Listings, reports and lookups over many sessions, issues, hits or entries at once
(S7, S11, S13, S17, P15, P33, P34, P37, F2, J14, A14, A17, A19, A22, O5, O8, E4, E7, K11, G11, G13-G15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import maintain as M
from quillgraph.operators import postings as X
from quillgraph.operators import search as R
from quillgraph.operators import workflow as W


def archive_days(entries: DataFrame) -> DataFrame:
    """Sessions and entries of each day of the archive layout (yyyy/MM/dd)."""
    return entries.groupBy(F.date_format("ts", "yyyy/MM/dd").alias("day")).agg(F.count_distinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n"))


def session_list(sessions: DataFrame, answers: DataFrame) -> DataFrame:
    """Sessions (session_id, phase, place), in each phase the last answered first."""
    last = answers.groupBy("session_id").agg(F.max("turn").alias("last_turn"))
    place = F.row_number().over(Window.partitionBy("phase").orderBy(F.desc_nulls_last("last_turn"), "session_id"))
    return sessions.join(last, "session_id", "left").withColumn("place", place).select("session_id", "phase", "place")


def issues_since(issues: DataFrame, cursor: Column) -> DataFrame:
    """Remote issues updated after the cursor."""
    return issues.filter(F.col("updated_at") > cursor)


def log_tail(events: DataFrame, n: int, at: str = "ts", key: str = "event_id") -> DataFrame:
    """The last ``n`` events, newest first; Spark keeps n rows a task before the sort."""
    return events.orderBy(F.desc(at), F.desc(key)).limit(n)


#: The remote state of a node's status, by type.
REMOTE_STATES: Mapping[str, Mapping[str, str]] = {
    "task": {"backlog": "Backlog", "in_progress": "In Progress", "done": "Done", "blocked": "Blocked", "cut": "Canceled"},
    "feature": {"draft": "Backlog", "active": "In Progress", "completed": "Done", "superseded": "Canceled", "archived": "Canceled"},
    "epic": {"draft": "planned", "active": "started", "completed": "completed", "archived": "canceled"},
}
#: The status of a remote state in lower case, by type.
LOCAL_STATUSES: Mapping[str, Mapping[str, str]] = {
    "task": {
        "backlog": "backlog",
        "triage": "backlog",
        "in progress": "in_progress",
        "started": "in_progress",
        "done": "done",
        "completed": "done",
        "blocked": "blocked",
        "canceled": "cut",
        "cancelled": "cut",
        "duplicate": "cut",
    },
    "feature": {
        "backlog": "draft",
        "triage": "draft",
        "in progress": "active",
        "started": "active",
        "done": "completed",
        "completed": "completed",
        "canceled": "superseded",
        "cancelled": "superseded",
        "duplicate": "superseded",
    },
    "epic": {
        "planned": "draft",
        "backlog": "draft",
        "started": "active",
        "in progress": "active",
        "completed": "completed",
        "done": "completed",
        "paused": "active",
        "canceled": "archived",
        "cancelled": "archived",
    },
}


def _mapped(node_type: Column, value: Column, *tables: Mapping[str, Mapping[str, str]]) -> Column:
    """The first table's value for the type and the value; null if none has one."""
    return F.coalesce(*[F.when((node_type == t) & (value == v), to) for table in tables for t, row in table.items() for v, to in row.items()], F.lit(None).cast("string"))


def remote_state(node_type: Column, status: Column, overrides: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """The remote state of a node's status; a project's own mapping goes first; null for a type or status without one."""
    return _mapped(node_type, status, overrides or {}, REMOTE_STATES)


def local_status(node_type: Column, state: Column, overrides: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """The status that a remote state stands for, in any case; a project's own mapping, status to state, is
    read backwards and goes first; null for a type or state without one."""
    back = {t: {v.lower(): k for k, v in reversed(row.items())} for t, row in (overrides or {}).items()}
    return _mapped(node_type, F.lower(state), back, LOCAL_STATUSES)


def fields(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, field, value) of the named fields that a node has; dates as yyyy-MM-dd."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd") if nodes.schema[c].dataType.typeName().startswith(("date", "timestamp")) else F.col(c).cast("string")
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), shown(c).alias("value"))) for c in columns]))
    return nodes.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.value")


def node_paths(nodes: DataFrame, node_types: DataFrame) -> DataFrame:
    """(id, file_path): the type's directory and the id."""
    return nodes.join(node_types.select("node_type", "directory"), "node_type").select("id", F.concat("directory", F.lit("/"), "id", F.lit(".md")).alias("file_path"))


def nodes_of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    """the nodes of a type."""
    return nodes.filter(F.col("node_type") == node_type)


def with_metadata(hits: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Hits (query_id, id, rank) with columns of their nodes."""
    return hits.join(nodes.select("id", *columns), "id").select("query_id", "id", "rank", *columns)


def ingest_report(parsed: DataFrame, key: str) -> DataFrame:
    """One row of counts over parsed lines with a ``_corrupt`` column: scanned, parsed, corrupt, distinct keys."""
    bad = F.col("_corrupt").isNotNull()
    return parsed.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~bad & F.col(key).isNotNull()).alias("parsed"), F.count_if(bad).alias("corrupt"), F.count_distinct(F.when(~bad, F.col(key))).alias("n_keys"))


def action_counts(plan: DataFrame) -> DataFrame:
    """How many rows of a push or pull plan have each action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def answer_summary(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits of each query by node type."""
    return hits.join(nodes.select("id", "node_type"), "id").groupBy("query_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


def health(nodes: DataFrame, entries: DataFrame, store: DataFrame, contents: DataFrame, node_types: DataFrame, edge_types: DataFrame, edges: DataFrame) -> DataFrame:
    """Warnings (check, subject, n): sessions without an end, contents without a vector, nodes and edges of types
    that the schema lacks, and nodes that have a type but no status where it is required."""
    row = lambda df, check, subject: df.groupBy(subject.alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "subject", "n")
    ends = entries.groupBy("session_id").agg(F.max("worktree").alias("worktree"), F.max("final").alias("final"))
    lacking = nodes.join(node_types.select("node_type", "required"), "node_type").filter(F.array_contains("required", "status") & F.col("status").isNull())
    parts = [
        row(ends.filter("not final"), "open_session", F.col("worktree")),
        row(contents.join(store.select("content_hash").distinct(), "content_hash", "left_anti"), "no_vector", F.col("node_type")),
        row(nodes.join(node_types, "node_type", "left_anti"), "unknown_node_type", F.col("node_type")),
        row(edges.join(edge_types, "edge_type", "left_anti"), "unknown_edge_type", F.col("edge_type")),
        row(lacking, "no_status", F.col("node_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fused_order(hits: DataFrame) -> DataFrame:
    """``place``: score, then word rank, then vector rank (nulls last), then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("word_rank"), F.asc_nulls_last("vector_rank"), "id")
    return hits.withColumn("place", F.row_number().over(w))


def by_status(nodes: DataFrame, statuses: Sequence[str], within: str) -> DataFrame:
    """``place`` in each group: by a custom order of statuses (others last), then id."""
    rank = F.coalesce(*[F.when(F.col("status") == s, k) for k, s in enumerate(statuses)], F.lit(len(statuses)))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(rank, "id")))


GAP = ["session_id", "gap_type", "node_type"]


def filled_gaps(before: DataFrame, after: DataFrame) -> DataFrame:
    """Gaps that were open and are not any more."""
    return before.join(after, GAP, "left_anti").select(*GAP)


def session_nodes(sessions: DataFrame, tentative: DataFrame) -> DataFrame:
    """The root and the tentative nodes of each session."""
    root = sessions.select("session_id", F.lit("root").alias("id"), F.lit(True).alias("is_root"))
    return root.unionByName(tentative.select("session_id", "id", F.lit(False).alias("is_root")))


def filtered_neighbours(vectors: DataFrame, queries: DataFrame, condition: Column, k: int) -> DataFrame:
    """The filter first, then the k nearest of what it leaves."""
    return R.nearest(vectors.filter(condition), queries, k)


def session_context(index: X.Index, sessions: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of a full-text index for each session's free text."""
    return X.search(index, X.terms(sessions, "session_id", "body"), k).select("query_id", "id", "rank")


def cascade(edges: DataFrame, names: DataFrame) -> DataFrame:
    """A session's edges with the new ids of ``names`` (session_id, target_id, new_id)."""
    return edges.join(names, ["session_id", "target_id"], "left").select("session_id", "edge_type", F.coalesce("new_id", "target_id").alias("target_id"))


def resolve_in_session(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids asked for in a session (session_id, query) among ``keys`` (session_id, id, query) of its own nodes;
    two hits are an error."""
    found = asked.join(keys.distinct(), ["session_id", "query"], "left").groupBy("session_id", "query").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    return found.select("session_id", "query", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "none").otherwise("ambiguous").alias("outcome"))


def commit_then_validate(tentative: DataFrame, new_edges: DataFrame, nodes: DataFrame, edges: DataFrame, node_types: DataFrame, allowed: DataFrame, edge_types: DataFrame) -> DataFrame:
    """(kind, detail): edges that a commit skips, beside the graph's errors."""
    skipped = W.commit_plan(tentative, new_edges, nodes).filter("outcome = 'skipped'").select(F.lit("skipped_edge").alias("kind"), F.col("key").alias("detail"))
    return skipped.unionByName(M.validate(nodes, edges, node_types, allowed, edge_types).filter("severity = 'error'").select("kind", "detail"))


def snippets(hits: DataFrame, size: int = 32, marks: tuple[str, str] = (">>>", "<<<"), more: str = "...") -> DataFrame:
    """(query_id, id, snippet): of each hit (with ``terms`` and ``body``) the ``size`` tokens with most query terms,
    the first of several, hits marked and cut ends shown.

    A hit's tokens meet its terms in a join, so long queries cost no scan a token. The best window ends at a hit, so
    only runs of hits are tried, at most ``size`` ahead of each."""
    cut = hits.select("query_id", "id", "terms", F.array_remove(F.split("body", r"[^\p{L}\p{N}]+", -1), "").alias("w"))
    asked = hits.select("query_id", F.explode("terms").alias("term")).distinct()
    tokens = cut.select("query_id", "id", F.posexplode("w").alias("at", "token")).withColumn("term", F.lower("token"))
    places = tokens.join(asked, ["query_id", "term"]).groupBy("query_id", "id").agg(F.sort_array(F.collect_list("at")).alias("p"))
    p = F.coalesce("p", F.array().cast("array<int>"))

    def run(first: Column, k: Column) -> Column:
        """The hits of the window from a hit on: how many, and the earliest window that holds them."""
        held = F.filter(F.slice(p, k + 1, size), lambda x: x < first + size)
        return F.struct(F.size(held).alias("n"), (-F.greatest(F.element_at(held, -1) - (size - 1), F.lit(0))).alias("i"))

    best = F.coalesce(-F.array_max(F.transform(p, run))["i"], F.lit(0))
    last = F.greatest(F.size("w") - size, F.lit(0))
    shown = cut.select("query_id", "id", "w").join(places, ["query_id", "id"], "left").select("query_id", "id", "w", p.alias("p"), best.alias("at"), last.alias("last"))
    marked = F.transform(F.slice("w", F.col("at") + 1, size), lambda x, i: F.when(F.array_contains("p", F.col("at") + i), F.concat(F.lit(marks[0]), x, F.lit(marks[1]))).otherwise(x))
    text = F.concat(F.when(F.col("at") > 0, more).otherwise(""), F.array_join(marked, " "), F.when(F.col("at") < F.col("last"), more).otherwise(""))
    return shown.select("query_id", "id", text.alias("snippet"))
