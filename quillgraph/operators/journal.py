"""The journal: filters, statistics, provenance and dedup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.ranks import prior
from quillgraph.operators.search import skip_budget


def filtered(entries: DataFrame, kinds: Sequence[str] = (), since: Column | None = None, tags: Sequence[str] = (), refs: Sequence[str] = ()) -> DataFrame:
    """Kind is any of ``kinds``, ts is not before ``since``, all ``tags`` and any of ``refs``; unset: no filter."""
    out = entries.filter(F.col("kind").isin(*kinds)) if kinds else entries
    out = out if since is None else out.filter(F.col("ts") >= since)
    out = out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0) if tags else out
    return out.filter(F.arrays_overlap("refs", F.array(*map(F.lit, refs)))) if refs else out


#: Kinds worth an embedding.
EMBEDDED_KINDS = ("decision", "finding", "dead_end", "outcome")


def rejection(summary: str = "summary", detail: str = "detail", kind: str = "kind") -> Column:
    """the first reason against an entry, null if it is valid."""
    n = F.length(F.trim(summary))
    return F.when(n < 20, "summary_short").when(n > 200, "summary_long").when(F.col(kind).isin("decision", "dead_end") & (F.length(F.coalesce(F.trim(detail), F.lit(""))) < 50), "detail_short")


#: What entries of a kind must have besides summary and detail.
REQUIRED: Mapping[str, Sequence[str]] = {"decision": ("chosen", "rationale", "reversible"), "dead_end": ("approach", "failure_mode"), "assumption": ("polarity",)}


def missing_field(entries: DataFrame, kind: str = "kind", required: Mapping[str, Sequence[str]] = REQUIRED) -> Column:
    """"missing_<field>" of the first field that the entry's kind requires and that is null or blank; a column that
    ``entries`` does not have is missing for all; null if there is none."""
    blank = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == "" if c in entries.columns else F.lit(True)
    return F.coalesce(*[F.when((F.col(kind) == k) & blank(c), f"missing_{c}") for k, cs in required.items() for c in cs])


def enforce(entries: DataFrame, mode: str = "redact", fields: Sequence[str] = ("summary", "detail"), rules: Mapping[str, str] = T.SECRET_RULES, bits: float | None = T.ENTROPY_BITS, length: int = T.ENTROPY_LENGTH) -> DataFrame:
    """The redaction policy over ``fields``.

    Every mode adds ``matches`` (rule, field, matched), field after field. "warn" leaves the rows as
    they are, "redact" replaces what matches, and "block" adds ``blocked`` (rule, field) of the first
    match, null for rows that may pass. ``rules`` and the entropy rule (``bits``, null for none, and
    ``length``) are the caller's."""
    if mode not in ("block", "redact", "warn"):
        raise ValueError(f"mode is block, redact or warn, not {mode!r}")

    def hits(field: str) -> Column:
        return F.transform(T.secret_hits(F.col(f"`{field}`"), rules, bits, length), lambda h: F.struct(h["rule"].alias("rule"), F.lit(field).alias("field"), h["matched"].alias("matched")))

    found = entries.withColumn("matches", F.concat(*map(hits, fields)))
    if mode == "block":
        return found.withColumn("blocked", F.when(F.size("matches") > 0, F.struct(F.get("matches", F.lit(0))["rule"].alias("rule"), F.get("matches", F.lit(0))["field"].alias("field"))))
    return found if mode == "warn" else found.withColumns({f: T.redact(F.col(f"`{f}`"), rules, bits, length) for f in fields})


def after_final(entries: DataFrame) -> DataFrame:
    """entries of a session later than its first final one."""
    ends = entries.filter("final").groupBy("session_id").agg(F.min("ts").alias("ended"))
    return entries.join(ends, "session_id").filter(F.col("ts") > F.col("ended")).drop("ended")


def exploded(entries: DataFrame, column: str, name: str) -> DataFrame:
    """The junction of entries with the distinct values of an array column."""
    return entries.select("id", "kind", F.explode(F.array_distinct(column)).alias(name))


def totals(entries: DataFrame) -> DataFrame:
    """One row of counts and the dead-end ratio (null without decisions and dead ends)."""
    ends, both = F.count_if(F.col("kind") == "dead_end"), F.count_if(F.col("kind").isin("dead_end", "decision"))
    return entries.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.count_distinct("agent").alias("n_agents"),
        F.count_if("provisional").alias("n_provisional"),
        F.count_if("final").alias("n_final"),
        F.round(F.try_divide(ends, both), 6).alias("dead_end_ratio"),
    )


def kind_counts(entries: DataFrame) -> DataFrame:
    """A5: entries by kind and their percentage of all."""
    counts = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def agent_sessions(entries: DataFrame) -> DataFrame:
    """Sessions of each agent."""
    return entries.groupBy("agent").agg(F.count_distinct("session_id").alias("n_sessions"))


def top_values(entries: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values of an array column with the most entries (ties by value)."""
    return exploded(entries, column, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def activity(entries: DataFrame, now: Column, window: int) -> DataFrame:
    """Entries of each of the last ``window`` + 1 days, zeros included, whatever other filters say."""
    spark = entries.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(now), window), F.to_date(now))).alias("day"))
    daily = entries.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    return days.join(daily, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def boosted(hits: DataFrame, now: Column) -> DataFrame:
    """Recency and kind boosts, and their sum as the score."""
    out = hits.withColumns({"recency": T.recency(F.col("ts"), now), "kind_boost": T.kind_boost(F.col("kind"))})
    return out.withColumn("score", F.col("recency") + F.col("kind_boost"))


def distinct_summaries(hits: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first of each (group, normalised summary, kind) in the given order."""
    rn = F.row_number().over(Window.partitionBy(*group, T.dedup_key(F.col("summary")), "kind").orderBy(*order))
    return hits.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def by_commits(entries: DataFrame, commits: DataFrame, now: Column, per_range: int = 40) -> DataFrame:
    """For each range of commits (range_id, sha) its newest entries, without repeated
    summaries: (range_id, id, ts, score). An entry without a head matches none."""
    hits = entries.join(commits.select("range_id", F.col("sha").alias("head")).distinct(), "head")
    return _newest(hits, "range_id", now, per_range)


def by_paths(entries: DataFrame, paths: DataFrame, now: Column, per_path: int = 40) -> DataFrame:
    """For each path its newest entries, without repeated summaries: (path, id, ts, score)."""
    touched = entries.withColumn("path", F.explode(F.array_distinct("files")))
    return _newest(touched.join(paths.select("path").distinct(), "path"), "path", now, per_path)


def _newest(hits: DataFrame, key: str, now: Column, n: int) -> DataFrame:
    """The ``n`` newest of each key stay in time order; dedup comes after."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), "id"))
    pulled = hits.withColumn("_at", rn).filter(F.col("_at") <= n)
    return boosted(distinct_summaries(pulled, [key], [F.col("_at")]), now).select(key, "id", "ts", F.round("score", 6).alias("score"))


def range_digest(entries: DataFrame, commits: DataFrame, now: Column, limit: int = 50, budget: int = 4000) -> DataFrame:
    """For each range of commits (range_id, sha) the newest ``limit`` distinct entries within a
    token budget: (range_id, id, ts, score, detail)."""
    return _digest(entries.join(commits.select("range_id", F.col("sha").alias("head")).distinct(), "head"), "range_id", now, limit, budget)


def path_digest(entries: DataFrame, paths: DataFrame, now: Column, limit: int = 50, budget: int = 4000) -> DataFrame:
    """As :func:`range_digest` for each path (path, id, ts, score, detail)."""
    touched = entries.withColumn("path", F.explode(F.array_distinct("files")))
    return _digest(touched.join(paths.select("path").distinct(), "path"), "path", now, limit, budget)


def _digest(hits: DataFrame, key: str, now: Column, limit: int, budget: int) -> DataFrame:
    """The newest max(40, 4 * limit) of each key, then dedup, the token budget and only then the limit."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), "id"))
    pulled = hits.withColumn("rank", rn).filter(F.col("rank") <= max(40, 4 * limit))
    single = distinct_summaries(pulled, [key], [F.col("rank")])
    fitted = skip_budget(single.select(F.col(key).alias("query_id"), "id", "rank", "summary", "detail"), budget)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = fitted.withColumn("_place", place).filter(F.col("_place") <= limit).select(F.col("query_id").alias(key), "id", "detail")
    return boosted(single.drop("detail").join(kept, [key, "id"]), now).select(key, "id", "ts", F.round("score", 6).alias("score"), "detail")


def unreferenced(nodes: DataFrame, entries: DataFrame, node_type: str, status: str) -> DataFrame:
    """Nodes of a type and status that no entry refers to."""
    named = entries.select(F.explode("refs").alias("id")).distinct()
    return nodes.filter((F.col("node_type") == node_type) & (F.col("status") == status)).join(named, "id", "left_anti")


def newest_open(entries: DataFrame) -> DataFrame:
    """The newest session without a final entry of each (worktree, agent)."""
    state = entries.groupBy("worktree", "agent", "session_id").agg(F.max("ts").alias("last"), F.max("final").alias("closed"))
    return state.filter("not closed").groupBy("worktree", "agent").agg(F.max(F.struct("last", "session_id")).alias("m")).select("worktree", "agent", F.col("m.session_id").alias("session_id"), F.col("m.last").alias("last"))


def first_seen(entries: DataFrame) -> DataFrame:
    """Agent and id of each session's first entry."""
    return entries.groupBy("session_id").agg(F.min(F.struct("ts", "id", "agent")).alias("m")).select("session_id", F.col("m.id").alias("first_id"), F.col("m.agent").alias("agent"), F.col("m.ts").alias("started"))


def transitions(changes: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """Each change of ``status`` of a key: (key, at, prior, status); repeats are none."""
    return prior(changes, [key], [F.asc(at), F.asc(tie)], status, "prior").filter(F.col("prior").isNotNull() & (F.col("prior") != F.col(status)))
