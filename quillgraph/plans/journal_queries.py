"""Registered queries over the journal view, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import journal as J
from quillgraph.operators.ranks import running
from quillgraph.plans.retrieval_queries import budget_sql
from quillgraph.sources import bindings as B

S = SparkSession
NOW = B.JOURNAL_NOW


def entries(s: S, d: str) -> DataFrame:
    return B.view(s, d, "entries")


E = B.oracle("entries")
NE = B.oracle("nodes", "entries")
REC = f"case when ts >= timestamp '{NOW}' then 0.5 else 0.5 * pow(2.0, -(epoch(timestamp '{NOW}') - floor(epoch(ts))) / 86400.0 / 14.0) end"
BOOST = "case kind when 'decision' then 0.5 when 'dead_end' then 0.5 when 'finding' then 0.3 when 'outcome' then 0.2 when 'assumption' then -0.1 else 0.0 end"
KEY = "lower(trim(regexp_replace(summary, '\\s+', ' ', 'g')))"


def digest(key: str, source: str, pull: int = 200, budget: int = 4000, limit: int = 50) -> str:
    """The newest ``pull`` entries of each key; of each normalised summary and kind the newest; those that fit the budget; ``limit`` of them."""
    return f"""{E}, h as materialized ({source}), p as (select *, row_number() over (partition by {key} order by ts desc, id) place from h qualify place <= {pull}),
 one as materialized (select *, {key} g from p qualify row_number() over (partition by {key}, {KEY}, kind order by place) = 1)""" + budget_sql("one", budget) + f"""
select {key}, id, {ts_sql("ts")} ts, round({REC} + {BOOST}, 6)::double score, detail
from (select * from fit qualify row_number() over (partition by g order by place) <= {limit}) f join (select * exclude (detail, place) from one) o using (g, id)"""


def commits(s: S, d: str) -> DataFrame:
    return B.raw(s, d, "events").select(F.concat(F.lit("range-"), F.pmod("event_id", F.lit(5))).alias("range_id"), F.concat(F.lit("sha"), F.pmod("event_id", F.lit(60))).alias("sha")).distinct()


def ts_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in names})


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def k8(s: S, d: str) -> DataFrame:
    hits = J.boosted(J.filtered(entries(s, d), since=F.lit("2024-01-10").cast("timestamp"), tags=("k1", "error")), B.journal_now())
    return hits.select("id", F.round("score", 6).alias("score"))


def t6(s: S, d: str) -> DataFrame:
    """Batch twin of the session lifecycle: a final entry closes a session, the next entry of the
    same (worktree, agent) opens another; sessions are numbered from 0."""
    entry = entries(s, d).withColumn("_f", F.col("final").cast("long"))
    numbered = running(entry, ["worktree", "agent"], [F.asc("ts"), F.asc("id")], F.col("_f"), "_t").withColumn("session_no", F.col("_t") - F.col("_f"))
    return numbered.groupBy("worktree", "agent", "session_no").agg(F.count(F.lit(1)).alias("n"), F.max("final").alias("closed"))


QUERIES = {
    "S9_junction_tags": (lambda s, d: J.exploded(entries(s, d), "tags", "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n")), E + "select tag, count(*) n from (select id, unnest(list_distinct(tags)) tag from entries) group by 1"),
    "F8_kind_since": (lambda s, d: J.filtered(entries(s, d), ("decision", "dead_end"), F.lit("2024-01-20").cast("timestamp")).select("id", "kind"), E + "select id, kind from entries where kind in ('decision', 'dead_end') and ts >= timestamp '2024-01-20'"),
    "F9_tags_refs": (lambda s, d: J.filtered(entries(s, d), tags=("k1", "view"), refs=tuple(f"o-{k}" for k in range(1, 200))).select("id"), E + "select id from entries where list_has_all(tags, ['k1', 'view']) and list_has_any(refs, (select list('o-' || i) from range(1, 200) r(i)))"),
    "F11_embedded_kinds": (lambda s, d: entries(s, d).filter(F.col("kind").isin(*J.EMBEDDED_KINDS)).select("id", T.embedding_text(F.col("summary"), F.col("detail")).alias("text")), E + "select id, summary || chr(10) || chr(10) || detail as text from entries where kind in ('decision', 'finding', 'dead_end', 'outcome')"),
    "F12_rejections": (lambda s, d: entries(s, d).select("id", J.rejection().alias("reason")), E + "select id, case when length(trim(summary)) < 20 then 'summary_short' when length(trim(summary)) > 200 then 'summary_long' when kind in ('decision', 'dead_end') and length(trim(detail)) < 50 then 'detail_short' end reason from entries"),
    "F13_after_final": (lambda s, d: J.after_final(entries(s, d).withColumn("final", F.col("id").like("%7"))).select("id"), E + ", f as (select session_id, min(ts) t from entries where id like '%7' group by 1) select id from entries join f using (session_id) where ts > t"),
    "A3_totals": (lambda s, d: J.totals(entries(s, d)), E + "select count(*) n_entries, count(distinct session_id) n_sessions, count(distinct agent) n_agents, count(*) filter (provisional) n_provisional, count(*) filter (final) n_final, round(count(*) filter (kind = 'dead_end') / nullif(count(*) filter (kind in ('dead_end', 'decision')), 0), 6) dead_end_ratio from entries"),
    "A5_kind_counts": (lambda s, d: J.kind_counts(entries(s, d)), E + "select kind, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 6) pct from entries group by 1"),
    "A6_agent_sessions": (lambda s, d: J.agent_sessions(entries(s, d)), E + "select agent, count(distinct session_id) n_sessions from entries group by 1"),
    "A7_top_tags": (lambda s, d: J.top_values(entries(s, d), "tags", 5), E + "select value, count(*) n from (select id, unnest(list_distinct(tags)) as value from entries) group by 1 order by 2 desc, 1 limit 5"),
    "A7_top_files": (lambda s, d: J.top_values(entries(s, d), "files", 10), E + "select value, count(*) n from (select id, unnest(list_distinct(files)) as value from entries) group by 1 order by 2 desc, 1 limit 10"),
    "A8_activity": (lambda s, d: J.activity(entries(s, d), B.journal_now(), 14).withColumn("day", F.col("day").cast("string")), E + f"select c.day::varchar as day, count(id) n from (select (date '{NOW[:10]}' - i::int) as day from range(0, 15) r(i)) c left join entries on ts::date = c.day group by 1"),
    "A21_refs_per_node": (lambda s, d: J.exploded(entries(s, d), "refs", "node").groupBy("node").agg(F.count(F.lit(1)).alias("n")), E + "select node, count(*) n from (select unnest(list_distinct(refs)) node from entries) group by 1"),
    "W2_distinct_summaries": (lambda s, d: J.distinct_summaries(entries(s, d), ["agent"], [F.desc("ts"), F.col("id")]).select("agent", "id"), E + f"select agent, id from entries qualify row_number() over (partition by agent, {KEY}, kind order by ts desc, id) = 1"),
    "W5_transitions": (lambda s, d: J.transitions(B.raw(s, d, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "prior", "event_type"), "select user_id, event_id, prior, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) prior from events) where prior <> event_type"),
    "W6_newest_open": (lambda s, d: ts_text(J.newest_open(entries(s, d).filter("not final or id like '%2'")), "last"), E + f", x as (select worktree, agent, session_id, max(ts) l, bool_or(final) c from entries where not final or id like '%2' group by all) select worktree, agent, max_by(session_id, (l, session_id)) session_id, {ts_sql('max(l)')} as last from x where not c group by 1, 2"),
    "W9_first_seen": (lambda s, d: ts_text(J.first_seen(entries(s, d)), "started"), E + f"select session_id, min_by(id, (ts, id)) first_id, min_by(agent, (ts, id)) agent, {ts_sql('min(ts)')} started from entries group by 1"),
    "O7_boosts": (lambda s, d: J.boosted(entries(s, d), B.journal_now()).select("id", F.round("score", 6).alias("score")), E + f"select id, round({REC} + {BOOST}, 6)::double score from entries"),
    "K8_filter_search": (k8, E + f"select id, round({REC} + {BOOST}, 6)::double score from entries where ts >= timestamp '2024-01-10' and list_has_all(tags, ['k1', 'error'])"),
    "K12_range_digest": (lambda s, d: ts_text(J.range_digest(entries(s, d), commits(s, d), B.journal_now()), "ts"), digest("range_id", "select e.*, range_id from entries e join (select distinct 'range-' || (event_id % 5) range_id, 'sha' || (event_id % 60) head from events) c using (head)")),
    "K13_path_digest": (lambda s, d: ts_text(J.path_digest(entries(s, d), entries(s, d).select(F.explode("files").alias("path")), B.journal_now()), "ts"), digest("path", "select * from (select *, unnest(list_distinct(files)) path from entries)")),
    "K14_by_id": (lambda s, d: entries(s, d).join(B.raw(s, d, "orders").select(F.concat(F.lit("e-"), "o_orderkey").alias("id")), "id", "left_semi").select("id", "summary"), E + "select id, summary from entries where id in (select 'e-' || o_orderkey from orders)"),
    "K16_lint": (lambda s, d: J.unreferenced(B.view(s, d, "nodes"), entries(s, d), "feature", "active").select("id", "title"), NE + "select id, title from nodes where node_type = 'feature' and status = 'active' and id not in (select unnest(refs) from entries)"),
    "T6_sessions_batch": (t6, E + ", x as (select *, coalesce(lag(final::int) over (partition by worktree, agent order by ts, id), 0) c from entries), y as (select *, sum(c) over (partition by worktree, agent order by ts, id rows unbounded preceding)::bigint session_no from x) select worktree, agent, session_no, count(*) n, bool_or(final) closed from y group by 1, 2, 3"),
}
