"""Registered queries of stores, migrations, reports and document parts, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import documents as DOC
from quillgraph.operators import embed as X
from quillgraph.operators import graph as G
from quillgraph.operators import journal as J
from quillgraph.operators import maintain as M
from quillgraph.operators import postings as PX
from quillgraph.operators import reports as P
from quillgraph.operators import search as SR
from quillgraph.operators import workflow as W
from quillgraph.plans import graph_queries as GQ
from quillgraph.plans import retrieval_queries as RQ
from quillgraph.plans import workflow_queries as WQ
from quillgraph.sources import bindings as B
from quillgraph.sources import markdown as MD
from quillgraph.sources.schema import ALLOWED_EDGES, EDGE_TYPES, NODE_TYPES, load_schema
from quillgraph.streaming import journal as SJ

S = SparkSession
C = F.col
N, E, D, NE = B.oracle("nodes"), B.oracle("entries"), B.oracle("docs"), B.oracle("nodes", "edges")


def nodes(s: S, d: str) -> DataFrame:
    return B.view(s, d, "nodes")


def edges(s: S, d: str) -> DataFrame:
    return B.view(s, d, "edges")


def hashed(s: S, d: str) -> DataFrame:
    """Documents with the hash of their text: copies share one."""
    return B.view(s, d, "docs").select("id", "node_type", F.sha2("body", 256).alias("content_hash"), C("body").alias("text"))


def store(s: S, d: str) -> DataFrame:
    """The vector store: one vector for each distinct text of documents that have one."""
    v = B.view(s, d, "vectors").select(C("id").cast("string").alias("id"), "embedding")
    return hashed(s, d).join(v, "id").groupBy("content_hash").agg(F.min_by("embedding", F.col("id").cast("long")).alias("embedding"))


STORE = D + ", h as materialized (select id, doc_id, node_type, sha256(body) content_hash from docs), st as materialized (select content_hash, min_by(embedding, doc_id) embedding from h join embeddings on vec_id = doc_id group by 1)"


def k19(s: S, d: str) -> DataFrame:
    empty = s.createDataFrame([], "content_hash string, model string, dim int, embedding array<float>")
    return X.fill(empty, hashed(s, d)).select("content_hash", "model", "dim", F.size("embedding").cast("long").alias("n"))


def schema_toml() -> str:
    """The bindings' schema as a schema file."""
    quoted = lambda xs: "[" + ", ".join(f'"{x}"' for x in xs) + "]"
    types = "".join(f'[node_types.{t}]\ndirectory = "{folder}"\nrequired_fields = {quoted(required)}\nallowed_statuses = {quoted(statuses)}\n' for t, folder, required, statuses in NODE_TYPES)
    allowed = "".join(f'[[edges]]\nsource = "{a}"\ntype = "{e}"\ntarget = "{b}"\n' for a, e, b in ALLOWED_EDGES)
    return types + allowed + "".join(f'[edge_types.{e}]\nreverse = "{back}"\n' for e, back in EDGE_TYPES)


def s4(s: S, d: str) -> DataFrame:
    """The nodes' types against the tables of a schema file."""
    schema = load_schema(s, schema_toml())
    t = schema["node_types"].join(schema["allowed_edges"].groupBy(C("source_type").alias("node_type")).agg(F.count(F.lit(1)).alias("n_allowed")), "node_type", "left")
    return G.type_counts(nodes(s, d)).join(t, "node_type", "left").select("node_type", "n", "directory", F.coalesce("n_allowed", F.lit(0)).cast("long").alias("n_allowed"))


def s7(s: S, d: str) -> DataFrame:
    return P.archive_days(B.view(s, d, "entries"))


def s8(s: S, d: str) -> DataFrame:
    e = B.view(s, d, "entries")
    return e.groupBy("session_id", "worktree").agg(F.min_by("agent", F.struct("ts", "id")).alias("agent"), F.max("final").alias("ready"), F.count(F.lit(1)).alias("n"))


def p15(s: S, d: str) -> DataFrame:
    return P.snippets(RQ.words(s, d, 10).join(RQ.asked(s, d), "query_id").join(RQ.docs(s, d).select("id", "body"), "id"))


def r3(s: S, d: str) -> DataFrame:
    """Under each persona of a section, the epics that it belongs to."""
    item = WQ.items(s, d).filter("ordinal = 0").select("root_id", C("target_id").alias("item_id"))
    return DOC.sub_items(item, edges(s, d), nodes(s, d), "child_of", "epic")


def r4(s: S, d: str) -> DataFrame:
    inner = DOC.internal_edges(WQ.items(s, d), edges(s, d), ("child_of", "depends_on"))
    return inner.groupBy("root_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("end_id").alias("first_target"))


def feature_briefs(s: S, d: str) -> DataFrame:
    """The sections of a brief for every feature, whose parents are its personas and theirs epics."""
    kinds = DOC.BriefEdges(parent=("serves", "persona"), decision=("child_of", "epic"), child=("served_by", "feature"), component=("uses", "component"), blocker="depends_on")
    return DOC.briefs(nodes(s, d).filter("node_type = 'feature'").select(C("id").alias("root_id")), nodes(s, d), edges(s, d), kinds)


def r9(s: S, d: str) -> DataFrame:
    """The document of each brief."""
    return DOC.brief_documents(feature_briefs(s, d)).select("root_id", F.sha2("document", 256).alias("document"))


def health(s: S, d: str) -> DataFrame:
    """One row: graph, sessions and embedding coverage."""
    g = G.graph_totals(nodes(s, d), edges(s, d)).select("n_nodes", "n_edges")
    e = s8(s, d).agg(F.count_if(F.expr("ready")).alias("n_ready"), F.count_if(F.expr("not ready")).alias("n_open"))
    c = X.coverage(store(s, d), hashed(s, d)).agg(F.sum("n_embedded").alias("n_embedded"))
    return g.join(e, F.lit(True)).join(c, F.lit(True))


def m12(s: S, d: str) -> DataFrame:
    """The rename plan of ids without a suffix; new ids are counted as distinct."""
    plan = M.suffix_plan(nodes(s, d).filter("node_type <> 'epic'"), ["o", "c", "p", "s"])
    return plan.groupBy("outcome", T.id_slug(C("new_id")).alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new_id").alias("n_ids"))


def used_triples(s: S, d: str) -> DataFrame:
    """The triples that the graph's edges have."""
    ends = lambda c: nodes(s, d).select(C("id").alias(f"{c}_id"), C("node_type").alias(f"{c}_type"))
    return edges(s, d).join(ends("source"), "source_id").join(ends("target"), "target_id").select("source_type", "edge_type", "target_type").distinct()


def m13(s: S, d: str) -> DataFrame:
    """Edge types that occur in the graph, against the schema: which deltas would be added."""
    return M.schema_deltas(used_triples(s, d), M.permitted(B.node_types(s), B.allowed_edges(s), B.edge_types(s)), B.node_types(s))


def m13_applied(s: S, d: str) -> DataFrame:
    """The schema with the deltas, applied twice."""
    known = M.permitted(B.node_types(s), B.allowed_edges(s), B.edge_types(s))
    once = M.upgraded(known, M.schema_deltas(used_triples(s, d), known, B.node_types(s)))
    return M.upgraded(once, M.schema_deltas(used_triples(s, d), once, B.node_types(s)))


def m10(s: S, d: str) -> DataFrame:
    """The index after a status change, for a store of the wanted version and for one of another."""
    old = nodes(s, d).withColumn("index_hash", M.index_hash("id", "status"))
    new = nodes(s, d).withColumn("status", F.when(C("id").like("o-%3"), "draft").otherwise(C("status"))).withColumn("index_hash", M.index_hash("id", "status"))
    row = lambda name, got: got[0].groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), F.lit(got[1]).alias("rebuilt"), "status", "n")
    return row("same", M.refreshed(old, new, "v2", "v2")).unionByName(row("other", M.refreshed(old, new, "v1", "v2"))).unionByName(row("unreadable", M.refreshed(old, new, None, "v2")))


def m15(s: S, d: str) -> DataFrame:
    snaps = WQ.snapshots(s, d)
    stay, go = W.pruned(snaps, 5, 4000)
    return stay.select("snapshot_key", F.lit(True).alias("stays")).unionByName(go.select("snapshot_key", F.lit(False).alias("stays")))


def m16(s: S, d: str) -> DataFrame:
    """A rebuilt journal index finds the vectors of its contents."""
    e = B.view(s, d, "entries").withColumn("content_hash", F.sha2(F.concat_ws("\n\n", "summary", "detail"), 256))
    v = e.filter("kind = 'decision'").select("content_hash").distinct()
    index, kept = W.rebuilt(e.unionByName(e.filter("kind = 'plan'")), v)
    return index.join(kept.withColumn("_v", F.lit(1)), "content_hash", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("n_embedded"))


M16 = E + """, h as (select id, kind, summary || chr(10) || chr(10) || detail c from entries), v as (select distinct c from h where kind = 'decision')
select kind, count(*) n, count(v.c) n_embedded from h left join v using (c) group by 1"""


def s14(s: S, d: str) -> DataFrame:
    """A template file's sections, one of them the user's, over all features as the graph is now."""
    built_in = MD.sections(s, TEMPLATE.format(name="brief", status='["active"]'))
    own = MD.sections(s, TEMPLATE.format(name="brief", status="[]"))
    rows = DOC.templates(built_in.unionByName(MD.sections(s, TEMPLATE.format(name="other", status='["retired"]'))), own)
    roots = nodes(s, d).filter("node_type = 'feature'").select(C("id").alias("root_id"))
    found = DOC.sections_at(roots, rows.filter("template = 'brief'"), edges(s, d), nodes(s, d), "current")
    return found.groupBy("ordinal", "heading").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root_id").alias("n_roots"))


TEMPLATE = """name = "{name}"
[[sections]]
heading = "Personas"
traverse = "serves"
target_type = "persona"
[[sections]]
heading = "Components"
traverse = "uses"
target_type = "component"
filter = {{ status = {status} }}
"""
S14 = NE + """, sc as (select * from (values (0, 'Personas', 'serves', 'persona'), (1, 'Components', 'uses', 'component')) v(ordinal, heading, edge_type, target_type))
select ordinal, heading, count(*) n, count(distinct source_id) n_roots from edges e join sc using (edge_type) join nodes n on n.id = target_id and n.node_type = target_type join nodes r on r.id = source_id and r.node_type = 'feature'
where valid_until is null and coalesce(n.status, '') <> 'superseded' group by 1, 2"""


def r8(s: S, d: str) -> DataFrame:
    """The same sections as of the root's day, now, and over all times."""
    sections = s.createDataFrame(WQ.SECTIONS, "ordinal int, heading string, edge_type string, target_type string, statuses array<string>")
    items = DOC.sections_of_modes(WQ.roots(s, d), sections, edges(s, d), nodes(s, d))
    shown = {"as_of": C("as_of"), "current": C("current"), "history": F.lit(True)}
    targets = items.groupBy("ordinal", "target_id").agg(*[F.count_if(c).alias(m) for m, c in shown.items()])
    counts = targets.groupBy("ordinal").agg(*[F.struct(F.sum(m).alias("n"), F.count_if(C(m) > 0).alias("n_targets"), F.lit(m).alias("mode")).alias(m) for m in shown])
    return counts.select("ordinal", F.inline(F.array(*shown))).filter("n > 0")


_R8 = "select ordinal, count(*) n, count(distinct target_id) n_targets, '{0}' as mode from ro join edges on root_id = source_id join sc using (edge_type) join nodes n on n.id = target_id and n.node_type = sc.target_type where {1} and (n.status is null or len(statuses) = 0 or list_contains(statuses, n.status)) group by 1"
R8 = WQ.ITEMS + " " + " union all ".join(_R8.format(m, w) for m, w in (("as_of", "(valid_from is null or valid_from <= day) and (valid_until is null or valid_until > day) and coalesce(n.status, '') <> 'superseded'"), ("current", "valid_until is null and coalesce(n.status, '') <> 'superseded'"), ("history", "true")))


def brief_sections(s: S, d: str) -> DataFrame:
    """How many briefs have each section."""
    return feature_briefs(s, d).groupBy("ordinal", "heading").agg(F.count(F.lit(1)).alias("n")).filter("ordinal > 1")


R9_SECTIONS = NE + """, f as (select id, title, body from nodes where node_type = 'feature'),
 pa as (select distinct f.id, p.id p from f join edges e on e.source_id = f.id and e.edge_type = 'serves' join nodes p on p.id = e.target_id and p.node_type = 'persona'),
 x as (
  select 2 ordinal, 'Directive' heading, id from f
  union all select 3, 'Objective', id from f where trim(regexp_replace(body, '^# [^\\n]*\\n*', '')) <> ''
  union all select distinct 5, 'Context', id from pa
  union all select distinct 6, 'Blocked by', f.id from f join edges e on e.source_id = f.id and e.edge_type = 'depends_on' join nodes b on b.id = e.target_id
  union all select distinct 7, 'Components', f.id from f join edges e on e.source_id = f.id and e.edge_type = 'uses' join nodes c on c.id = e.target_id and c.node_type = 'component'
  union all select distinct 9, 'Siblings', pa.id from pa join edges e on e.source_id = pa.p and e.edge_type = 'served_by' and e.target_id <> pa.id join nodes n on n.id = e.target_id and n.node_type = 'feature'
  union all select 10, 'When done', id from f)
select ordinal, heading, count(*) n from x group by 1, 2"""


def r11(s: S, d: str) -> DataFrame:
    return DOC.attachments(nodes(s, d), edges(s, d)).select("source_id", "edge_idx", "title", "subtitle", "url", "metadata")



def k15(s: S, d: str) -> DataFrame:
    """The statistics report as (part, key, value) rows."""
    e = B.view(s, d, "entries")
    rows = lambda part, df, k, v: df.select(F.lit(part).alias("part"), C(k).cast("string").alias("key"), C(v).cast("double").alias("value"))
    out = rows("kind", J.kind_counts(e), "kind", "n")
    for part, df, k, v in (("agent", J.agent_sessions(e), "agent", "n_sessions"), ("tag", J.top_values(e, "tags", 10), "value", "n"), ("file", J.top_values(e, "files", 10), "value", "n"), ("day", J.activity(e, B.journal_now(), 7), "day", "n")):
        out = out.unionByName(rows(part, df, k, v))
    return out


K15 = E + f"""select 'kind' part, kind as key, count(*)::double as value from entries group by kind
union all select 'agent', agent, count(distinct session_id)::double from entries group by agent
union all (select 'tag', t, count(*)::double from (select unnest(list_distinct(tags)) t from entries) group by t order by 3 desc, 2 limit 10)
union all (select 'file', t, count(*)::double from (select unnest(list_distinct(files)) t from entries) group by t order by 3 desc, 2 limit 10)
union all select 'day', c.day::varchar, count(id)::double from (select (date '{B.JOURNAL_NOW[:10]}' - i::int) as day from range(0, 8) r(i)) c left join entries on ts::date = c.day group by c.day"""


def o5(s: S, d: str) -> DataFrame:
    return P.fused_order(RQ.k7(s, d)).select("query_id", "id", "place")


def t5(s: S, d: str) -> DataFrame:
    """T5: tumbling day windows."""
    return B.view(s, d, "entries").groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def corpus(s: S, d: str) -> DataFrame:
    return SR.corpus(RQ.docs(s, d), "title", "body")


def title_phrases(s: S, d: str) -> DataFrame:
    """Whole titles as phrases."""
    return SR.phrases(corpus(s, d), RQ.asked(s, d))


def prefix_queries(s: S, d: str) -> DataFrame:
    return RQ.asked(s, d).select("query_id", F.left(F.element_at("terms", -1), F.lit(3)).alias("prefix")).filter("prefix is not null")


def r5_typed(s: S, d: str) -> DataFrame:
    """Each root's 30 nearest others among all vectors of its type."""
    v = B.view(s, d, "vectors")
    return DOC.semantic_section(v, v.filter("id % 100 = 0").select(C("id").alias("query_id"), "node_type", "embedding"), 30)


def r10(s: S, d: str) -> DataFrame:
    """The issue body of every feature."""
    roots = nodes(s, d).filter("node_type = 'feature'").select(C("id").alias("root_id"))
    return DOC.issue_bodies(roots, nodes(s, d), edges(s, d)).select("root_id", F.sha2("body", 256).alias("payload"))


#: A node's own text, and the first line after its headings and blank lines.
OWN = "trim(regexp_replace(body, '^# [^\\n]*\\n*', ''), ' ' || chr(9) || chr(10) || chr(13))"
LEAD = "regexp_extract(body, '^(?:(?:#[^\\n]*|[ \\t]*)\\n)*([^#\\n][^\\n]*)', 1)"
R10 = NE + f""", x as (
  select source_id, edge_idx, case when edge_type = 'child_of' then 0 when edge_type = 'serves' then 1 when edge_type = 'depends_on' then 2 else 3 end k,
    case when edge_type = 'child_of' then 'Parents' when edge_type = 'serves' then 'Personas' when edge_type = 'depends_on' then 'Decisions' else 'Components' end heading,
    '- **' || title || '** (' || coalesce(status, '—') || ')' || case when {LEAD} <> '' then ': ' || {LEAD} else '' end line
  from edges join nodes on id = target_id
  where (edge_type = 'child_of' and node_type in ('epic', 'feature', 'task')) or (edge_type = 'serves' and node_type = 'persona') or (edge_type = 'depends_on' and node_type = 'decision') or (edge_type in ('uses', 'exposes') and node_type in ('component', 'api_surface'))),
 p as (select source_id, k, '<details><summary>' || heading || '</summary>' || chr(10) || chr(10) || string_agg(line, chr(10) order by edge_idx, line) || chr(10) || '</details>' t from x group by source_id, k, heading),
 f as (select source_id id, string_agg(t, chr(10) || chr(10) order by k) folds from p group by 1)
select id root_id, sha256(concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), nullif({OWN}, ''), folds)) payload from nodes left join f using (id) where node_type = 'feature'"""


def g17(s: S, d: str) -> DataFrame:
    """Orders and customers ask for the issue after their own; some nodes are gone."""
    k = F.substring("id", 3, 20).cast("long")
    asked = nodes(s, d).filter("node_type in ('feature', 'persona')").select("id", F.concat(F.lit("L-"), k + 1).alias("linear_id"))
    gone = B.raw(s, d, "nation").select(F.concat(F.lit("gone-x-"), "n_nationkey").alias("id"), F.concat(F.lit("X-"), "n_nationkey").alias("linear_id"))
    return W.linked(nodes(s, d), WQ.state(s, d), asked.unionByName(gone))


def features(s: S, d: str) -> DataFrame:
    return P.nodes_of_type(nodes(s, d), "feature")


def g11(s: S, d: str) -> DataFrame:
    """The top documents for each interview's problem statement."""
    return P.session_context(PX.build(RQ.docs(s, d), *RQ.SEARCHED), WQ.sessions(s, d))


def g14(s: S, d: str) -> DataFrame:
    """Types asked for in a session, as the first part of its own nodes' ids."""
    t = WQ.tentative(s, d)
    return P.resolve_in_session(t.select("session_id", C("node_type").alias("query")).distinct(), t.select("session_id", "id", F.regexp_extract("id", "^([a-z]+)-", 1).alias("query")))


def g15(s: S, d: str) -> DataFrame:
    """A commit's skipped edges beside the graph's issues."""
    return P.commit_then_validate(WQ.tentative(s, d), WQ.tentative_edges(s, d), nodes(s, d), edges(s, d), B.node_types(s), B.allowed_edges(s), B.edge_types(s)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def t7(s: S, d: str) -> DataFrame:
    """The batch twin of the stateful stream, with event types as statuses."""
    moved = J.transitions(B.raw(s, d, "events"), "user_id", "event_type", "ts", "event_id")
    kind = F.when(C("event_type") == "view", "plan").when(C("event_type") == "purchase", "outcome").when(C("event_type") == "error", "risk")
    return moved.select("user_id", "event_id", kind.alias("kind")).filter("kind is not null")


RED = "detail"
for _name, _pattern in T.SECRET_RULES.items():
    RED = f"regexp_replace({RED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '<REDACTED:{_name}>', 'g')"
G10 = WQ.SY + """, pu as (select id, linear_id, case when linear_id is null then 'create' when content_hash = hash_at_sync and node_type <> 'epic' then 'skip' else 'update' end as action from sn left join st on node_id = id where node_type in ('epic', 'feature', 'task')),
 pl as (select iu.id, case when st.node_id is null then case when pa.linear_id is not null then 'import' else 'ignore' end when iu.updated_at <= st.updated_at then 'unchanged' when content_hash <> st.hash_at_sync then 'conflict' when archived then 'archived' when remote_status is not null and remote_status is distinct from sn.status then 'status_change' else 'touched' end as action
   from iu left join st on st.linear_id = iu.id left join sn on sn.id = st.node_id left join st pa on pa.linear_id = iu.parent
   where iu.id not in (select linear_id from pu where action = 'update' and linear_id is not null))
select 'push' step, action, count(*) n, min(id) first_id from pu group by action union all select 'pull', action, count(*), min(id) from pl group by action"""
CC = "concat_ws(' ', title, body)"
ORDER = "case status when 'completed' then 0 when 'active' then 1 when 'draft' then 2 else 3 end"
M13_APPLIED = B.oracle("nodes", "edges", "node_types", "allowed_edges", "edge_types") + """, flat as (select s.node_type source_type, a.edge_type, t.node_type target_type from allowed_edges a join node_types s on a.source_type = '*' or a.source_type = s.node_type join node_types t on a.target_type = '*' or a.target_type = t.node_type),
 tr as (select * from flat union select target_type, reverse, source_type from flat join edge_types using (edge_type)),
 u as (select distinct a.node_type source_type, edge_type, b.node_type target_type from edges join nodes a on a.id = source_id join nodes b on b.id = target_id)
select * from tr union select * from u where source_type in (select node_type from node_types)"""


def warnings(s: S, d: str) -> DataFrame:
    return P.health(nodes(s, d), B.view(s, d, "entries"), store(s, d), hashed(s, d), B.node_types(s), B.edge_types(s), edges(s, d))


WARNINGS = B.oracle("nodes", "edges", "entries", "docs", "node_types", "edge_types") + """, h as (select doc_id, node_type, sha256(body) c from docs), st as (select distinct c from h join embeddings on vec_id = doc_id),
 se as (select session_id, max(worktree) w, bool_or(final) r from entries group by 1)
select 'open_session' as check, w subject, count(*) n from se where not r group by 2
union all select 'no_vector', node_type, count(*) from h where c not in (select c from st) group by 2
union all select 'unknown_node_type', node_type, count(*) from nodes where node_type not in (select node_type from node_types) group by 2
union all select 'unknown_edge_type', edge_type, count(*) from edges where edge_type not in (select edge_type from edge_types) group by 2
union all select 'no_status', node_type, count(*) from nodes join node_types using (node_type) where list_contains(required, 'status') and status is null group by 2"""

_E = "chr(10)"
#: Targets of a root's edges of one type, each once, at its first place.
_HOP = "(select {root} root_id, nodes.id, min(edge_idx) o, any_value(nodes.title) t, any_value(nodes.status) s, any_value({own}) b, any_value({lead}) lead from {start} join edges on source_id = {by} and edge_type = '{edge}' join nodes on nodes.id = target_id where {where} group by 1, 2)"
_hop = lambda start, root, by, edge, where: _HOP.format(start=start, root=root, by=by, edge=edge, where=where, own=OWN, lead=LEAD)
_MARK = "case s when 'done' then '[x]' when 'decided' then '[x]' when 'answered' then '[x]' when 'in_progress' then '[~]' when 'blocked' then '[!]' when 'cut' then '[-]' else '[ ]' end"
_ITEMS = f"string_agg('- ' || {_MARK} || ' ' || t || ' (' || id || ')', {_E} order by o, id)"
R9 = NE + f""", f as materialized (select id root_id, title ft, status fs, {OWN} own from nodes where node_type = 'feature'),
 pa as materialized {_hop("f", "f.root_id", "f.root_id", "serves", "node_type = 'persona'")},
 gr as {_hop("pa", "pa.root_id", "pa.id", "child_of", "node_type = 'epic'")},
 bl as {_hop("f", "f.root_id", "f.root_id", "depends_on", "true")},
 co as {_hop("f", "f.root_id", "f.root_id", "uses", "node_type = 'component'")},
 si as {_hop("pa", "pa.root_id", "pa.id", "served_by", "node_type = 'feature' and target_id <> pa.root_id")},
 sc as (select root_id, string_agg(t, ' > ' order by k, o) scope from (select root_id, t, o, 0 k from gr union all select root_id, t, o, 1 from pa) group by 1),
 se as (
  select root_id, 1 n, '# ' || ft || {_E} || {_E} || 'Task ' || root_id || coalesce(', ' || fs, '') || coalesce({_E} || 'Scope: ' || scope, '') t from f left join sc using (root_id)
  union all select root_id, 2, '## Directive' || {_E} || {_E} || case when root_id in (select root_id from bl) then '{DOC.WORDING["complex"]}' else '{DOC.WORDING["simple"]}' end from f
  union all select root_id, 3, '## Objective' || {_E} || {_E} || own from f where own <> ''
  union all select root_id, 5, '## Context' || {_E} || {_E} || string_agg('### ' || t || coalesce(' (' || s || ')', '') || {_E} || lead, {_E} order by o, id) from pa group by 1
  union all select root_id, 6, '## Blocked by' || {_E} || {_E} || {_ITEMS} from bl group by 1
  union all select root_id, 7, '## Components' || {_E} || {_E} || string_agg('### ' || t || {_E} || b, {_E} order by o, id) from co group by 1
  union all select root_id, 9, '## Siblings' || {_E} || {_E} || {_ITEMS} from si group by 1
  union all select root_id, 10, '## When done' || {_E} || {_E} || '{DOC.WORDING["done"]}' from f)
select root_id, sha256(string_agg(t, {_E} || {_E} order by n)) document from se group by 1"""


QUERIES = {
    "S4_schema_tables": (s4, B.oracle("nodes", "node_types", "allowed_edges") + "select n.node_type, n, directory, (select count(*) from allowed_edges a where a.source_type = n.node_type and directory is not null) n_allowed from (select node_type, count(*) n from nodes group by 1) n left join node_types t on t.node_type = n.node_type"),
    "S7_archive_days": (s7, E + "select strftime(ts, '%Y/%m/%d') as day, count(distinct session_id) n_sessions, count(*) n from entries group by 1"),
    "S8_session_states": (s8, E + "select session_id, worktree, min_by(agent, (ts, id)) agent, bool_or(final) ready, count(*) n from entries group by 1, 2"),
    "S10_store": (lambda s, d: store(s, d).select("content_hash", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("x")), STORE + " select content_hash, round(embedding[1]::double, 6) x from st"),
    "S15_json_rows": (lambda s, d: MD.to_json_rows(nodes(s, d).select("id", "status")), N + """select '{"id":"' || id || '","status":' || coalesce('"' || status || '"', 'null') || '}' as value from nodes"""),
    "S18_import_texts": (lambda s, d: MD.import_texts(B.view(s, d, "docs").select(C("id").alias("file_path"), C("body").alias("content")), "feature").select("file_path", "id", "status"), D + ", f as (select id file_path, trim(regexp_replace(coalesce(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: trim(x) <> '')[1], ''), '^\\s*#+\\s*', '')) l from docs), x as (select file_path, replace(trim(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g')), ' ', '-') j from f) select file_path, 'feature-' || case when length(j) <= 50 then j when contains(left(j, 51), '-') then regexp_replace(left(j, 51), '-[^-]*$', '') else left(j, 50) end id, 'draft' status from x"),
    "P7_renumbered_edges": (lambda s, d: M.renumber(edges(s, d)).select("source_id", "target_id", "edge_type", "edge_idx"), B.oracle("edges") + "select source_id, target_id, edge_type, (row_number() over (partition by source_id order by target_id, edge_type, valid_from nulls first) - 1)::int edge_idx from edges"),
    "P15_snippets": (p15, RQ.DWORDS + f""", tm as (select id query_id, {RQ.TOK.format('title')} t from dx where id % 100 = 0),
 sn as materialized (select query_id, id, t, list_filter(regexp_split_to_array(body, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from hits join dx using (id) join tm using (query_id) where rank <= 10),
 sh as materialized (select *, list_transform(w, lambda x: list_contains(t, lower(x))::int) h, greatest(len(w) - 32, 0) z from sn),
 sa as materialized (select *, 0 - list_max(list_transform(range(0, z + 1), lambda i: coalesce(list_sum(h[i + 1:i + 32]), 0)::bigint * 100000000 - i)) % 100000000 r from sh),
 sb as (select *, case when r < 0 then r + 100000000 else r end s from sa)
select query_id, id, case when s > 0 then '...' else '' end || array_to_string(list_transform(w[s + 1:s + 32], lambda x: case when list_contains(t, lower(x)) then '>>>' || x || '<<<' else x end), ' ') || case when s < z then '...' else '' end snippet from sb"""),
    "P16_hop_score": (lambda s, d: B.raw(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.hop_score(C("l_linenumber")).alias("score")), "select l_orderkey, l_linenumber, (case l_linenumber when 0 then 1.0 when 1 then 0.8 when 2 then 0.5 else greatest(0.3, 0.5::double - 0.1::double * (l_linenumber - 2)) end)::double score from lineitem"),
    "P36_angle": (lambda s, d: WQ.found(s, d).join(WQ.sessions(s, d).select("session_id", "body"), "session_id").select("session_id", "gap_type", "node_type", T.suggested_angle(C("gap_type"), C("body")).alias("angle")), WQ.I0 + ", an0 as (select session_id, gap_type, gp.node_type, lower(coalesce(se.body, '')) b from gp join se using (session_id)) select session_id, gap_type, node_type, case " + " ".join(f"when gap_type = '{g}' and ({' or '.join(f'contains(b, {chr(39)}{w}{chr(39)})' for w in ws) or 'true'}) then '{t.replace(chr(39), chr(39) * 2)}'" for g, choices in T.ANGLES.items() for ws, t in choices) + " end angle from an0"),
    "F10_min_similarity": (lambda s, d: RQ.vector_hits(s, d, 50).filter("similarity >= 0.2").select("query_id", "id"), RQ.VEC + RQ.knn_sql("vectors", 50) + " select query_id, id from near where round(similarity, 9) >= 0.2"),
    "J7_current_vectors": (lambda s, d: X.current(hashed(s, d).withColumn("content_hash", F.when(C("id").like("%3"), "stale").otherwise(C("content_hash"))), hashed(s, d)).select("id"), D + "select id from docs where id not like '%3'"),
    "J8_shared_vectors": (lambda s, d: X.shared(store(s, d), hashed(s, d)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("n_vectors")), STORE + " select node_type, count(*) n, count(distinct content_hash) n_vectors from h join st using (content_hash) group by 1"),
    "J9_pending": (lambda s, d: X.missing(store(s, d), hashed(s, d)).select("id"), STORE + " select id from h where content_hash not in (select content_hash from st)"),
    "J14_hits_with_metadata": (lambda s, d: P.with_metadata(RQ.words(s, d, 10), RQ.docs(s, d), "node_type", "owner"), RQ.DWORDS + " select query_id, id, rank, node_type, owner from hits join dx using (id) where rank <= 10"),
    "A10_coverage": (lambda s, d: X.coverage(store(s, d), hashed(s, d)), STORE + " select node_type, count(*) n, count(st.content_hash) n_embedded from h left join st using (content_hash) group by 1"),
    "A11_backlog": (lambda s, d: B.view(s, d, "entries").filter(~C("kind").isin(*J.EMBEDDED_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), E + "select kind, count(*) n from entries where kind not in ('decision', 'finding', 'dead_end', 'outcome') group by 1"),
    "A17_health": (health, B.oracle("nodes", "edges", "entries", "docs") + ", h as (select doc_id, sha256(body) c from docs), st as (select distinct c from h join embeddings on vec_id = doc_id), se as (select session_id, bool_or(final) r from entries group by 1) select (select count(*) from nodes) n_nodes, (select count(*) from edges) n_edges, (select count(*) from se where r) n_ready, (select count(*) from se where not r) n_open, (select count(*) from h where c in (select c from st))::bigint n_embedded"),
    "A22_answer_summary": (lambda s, d: P.answer_summary(RQ.k4(s, d, True), nodes(s, d)), RQ.k4_sql(True).replace("select query_id, id, rank, round(score, 6) score from rk where", "select query_id, node_type, count(*) n from rk join nx using (id) where") + " group by 1, 2"),
    "O5_fused_order": (o5, f"select query_id, id, (row_number() over (partition by query_id order by score desc, word_rank nulls last, vector_rank nulls last, id))::int place from ({RQ.K7})"),
    "O8_status_order": (lambda s, d: P.by_status(features(s, d), ("completed", "active", "draft"), "owner").select("owner", "id", "place"), N + f"select owner, id, (row_number() over (partition by owner order by {ORDER}, id))::int place from nodes where node_type = 'feature'"),
    "E2_prune": (lambda s, d: X.prune(B.raw(s, d, "embeddings").select(F.concat(F.lit("o-"), C("vec_id") * 37).alias("id")), nodes(s, d)), N + "select 'o-' || vec_id * 37 id from embeddings where 'o-' || vec_id * 37 not in (select id from nodes)"),
    "E7_root_and_tentative": (lambda s, d: P.session_nodes(WQ.sessions(s, d), WQ.tentative(s, d)), WQ.I0 + " select session_id, 'root' id, true is_root from se union all select session_id, id, false from te"),
    "K5_context": (lambda s, d: RQ.k4(s, d, True).join(nodes(s, d).select("id", "title", "body"), "id").select("query_id", "rank", "id", F.sha2(F.concat_ws("\n\n", "title", "body"), 256).alias("text_hash")), RQ.k4_sql(True).replace("select query_id, id, rank, round(score, 6) score from rk where", "select query_id, rank, id, sha256(title || chr(10) || chr(10) || body) text_hash from rk join nx using (id) where")),
    "K9_explain": (lambda s, d: J.boosted(B.view(s, d, "entries"), B.journal_now()).select("id", F.round("recency", 6).alias("recency"), C("kind_boost").alias("kind_boost")), E + f"select id, round({RQ.REC}, 6)::double recency, ({RQ.BOOST})::double kind_boost from entries"),
    "K11_filtered_neighbours": (lambda s, d: P.filtered_neighbours(B.view(s, d, "vectors"), B.view(s, d, "vectors").filter("id % 100 = 0").select(C("id").alias("query_id"), "embedding"), C("node_type") == 1, 10).select("query_id", "id", "rank"), RQ.VEC + ", vn as (select id, embedding e, node_type from vectors), vp as (select a.id query_id, b.id, list_cosine_similarity(a.e::double[], b.e::double[]) similarity from vn a, vn b where a.id % 100 = 0 and b.node_type = 1) select query_id, id, (row_number() over (partition by query_id order by round(similarity, 9) desc, id))::int rank from vp qualify rank <= 10"),
    "K15_statistics": (k15, K15),
    "K19_embedding_fill": (k19, D + "select distinct sha256(body) content_hash, 'hashed-words-64' model, 64::int dim, 64::bigint n from docs"),
    "M12_suffix_plan": (m12, N + "select 'rename' outcome, regexp_replace(id, '^[ocps]-', '') slug, count(*) n, count(*) n_ids from nodes where node_type <> 'epic' and not regexp_matches(id, '^.+-[0-9a-hjkmnp-tv-z]{6}$') group by 1, 2 union all select 'look_alike', null, count(*), 0 from nodes where node_type <> 'epic' and regexp_matches(id, '^.+-[0-9a-hjkmnp-tv-z]{6}$') and not regexp_matches(id, '-[a-z]*[0-9][0-9a-z]*$') having count(*) > 0"),
    "M10_refreshed": (m10, N + ", x as (select case when id like 'o-%3' then 'draft' else status end status from nodes) select store, store <> 'same' rebuilt, status, count(*) n from x, (values ('same'), ('other'), ('unreadable')) v(store) group by all"),
    "M13_applied": (m13_applied, M13_APPLIED),
    "M15_pruned": (m15, WQ.QUERIES["W8_retention"][1].replace("select k snapshot_key, reason from f", "select k snapshot_key, reason <> 'evict' stays from f")),
    "M16_rebuilt": (m16, M16),
    "S14_template": (s14, S14),
    "R8_modes": (r8, R8),
    "R9_sections": (brief_sections, R9_SECTIONS),
    "A17_warnings": (warnings, WARNINGS),
    "M13_schema_deltas": (m13, B.oracle("nodes", "edges", "node_types", "allowed_edges", "edge_types") + """, flat as (select s.node_type source_type, a.edge_type, t.node_type target_type from allowed_edges a join node_types s on a.source_type = '*' or a.source_type = s.node_type join node_types t on a.target_type = '*' or a.target_type = t.node_type),
 tr as (select * from flat union select target_type, reverse, source_type from flat join edge_types using (edge_type)),
 u as (select distinct a.node_type source_type, edge_type, b.node_type target_type from edges join nodes a on a.id = source_id join nodes b on b.id = target_id)
select u.*, case when tr.edge_type is not null then 'already_present' when n.node_type is null then 'skipped_unknown_type' else 'added' end outcome from u left join tr using (source_type, edge_type, target_type) left join node_types n on n.node_type = source_type"""),
    "R3_sub_items": (r3, WQ.ITEMS + " select root_id, it.target_id item_id, e.target_id, n.title sub_title from it join edges e on e.source_id = it.target_id and e.edge_type = 'child_of' join nodes n on n.id = e.target_id and n.node_type = 'epic' where ordinal = 0 and coalesce(n.status, '') <> 'superseded'"),
    "R4_internal_edges": (r4, WQ.ITEMS + " select root_id, ordinal, count(*) n, min(e.target_id) first_target from it join edges e on e.source_id = it.target_id and e.edge_type in ('child_of', 'depends_on') group by 1, 2"),
    "R6_root_types": (lambda s, d: DOC.accepts_root(nodes(s, d), ("feature", "epic")), N + "select id, node_type in ('feature', 'epic') accepted from nodes"),
    "R9_briefs": (r9, R9),
    "R11_context_attachments": (r11, NE + """select source_id, edge_idx, title, node_type || ' (' || coalesce(status, '—') || ') — ' || replace(regexp_replace(body, '^# [^\\n]*\\n+', ''), chr(10), ' ') subtitle, 'graph://' || target_id url,
  '{"nodeId":"' || target_id || '","nodeType":"' || node_type || '","edgeType":"' || edge_type || '","status":"' || coalesce(status, '—') || '"}' metadata
from edges join nodes on id = target_id where node_type in ('decision', 'persona', 'component')"""),
    "R11_attachments": (lambda s, d: G.outgoing(nodes(s, d), edges(s, d).filter(C("edge_type").isin("serves", "depends_on", "child_of"))).select("source_id", "target_id", "edge_type", C("target_title").alias("label")), NE + "select source_id, target_id, edge_type, title label from edges join nodes on id = target_id where edge_type in ('serves', 'depends_on', 'child_of')"),
    "G13_cascade": (lambda s, d: P.cascade(WQ.tentative_edges(s, d), WQ.tentative(s, d).filter("node_type = 'persona'").select("session_id", C("id").alias("target_id"), F.concat(F.lit("new-"), "id").alias("new_id"))), WQ.I0 + " select session_id, edge_type, case when target_id in (select id from te where te.session_id = ed.session_id and node_type = 'persona') then 'new-' || target_id else target_id end target_id from ed"),
    "G16_dry_run": (lambda s, d: W.push_plan(WQ.synced_nodes(s, d), WQ.state(s, d)).groupBy("ord").agg(F.count_if(F.expr("action = 'create'")).alias("n_create"), F.count_if(F.expr("action = 'update'")).alias("n_update"), F.count_if(F.expr("action = 'skip'")).alias("n_skip")), WQ.SY + ", a as (select case node_type when 'epic' then 0 when 'feature' then 1 else 2 end ord, case when linear_id is null then 'create' when content_hash = hash_at_sync and node_type <> 'epic' then 'skip' else 'update' end x from sn left join st on node_id = id where node_type in ('epic', 'feature', 'task')) select ord, count(*) filter (x = 'create') n_create, count(*) filter (x = 'update') n_update, count(*) filter (x = 'skip') n_skip from a group by 1"),
    "G17_link": (g17, WQ.SY + """, q as (select id, 'L-' || (k + 1) linear_id from (select id, try_cast(substr(id, 3) as bigint) k from nodes where node_type in ('feature', 'persona')) union all select 'gone-x-' || n_nationkey, 'X-' || n_nationkey from nation)
select q.id, q.linear_id, case when n.id is null then 'no_node' when n.node_type not in ('epic', 'feature', 'task') then 'wrong_type' when o.node_id is not null and o.node_id <> q.id then 'taken' when w.linear_id = q.linear_id then 'unchanged' when w.linear_id is not null then 'relinked' else 'linked' end outcome
from q left join nodes n using (id) left join st w on w.node_id = q.id left join st o on o.linear_id = q.linear_id"""),
    "K6_whole_phrases": (title_phrases, RQ.DOCS + f", x as materialized (select id, w, ' ' || array_to_string(w, '  ') || ' ' s from (select id, {RQ.TOK.format(CC)} w from dx)), q as (select id query_id, p, ' ' || array_to_string(p, '  ') || ' ' s from (select id, {RQ.TOK.format('title')} p from dx where id % 100 = 0) where len(p) > 0), y as materialized (select query_id, id, w, p from x join q on contains(x.s, q.s)) select query_id, id, len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) n from y"),
    "K6_prefixes": (lambda s, d: SR.prefixes(corpus(s, d), prefix_queries(s, d)), RQ.DOCS + f", x as materialized (select id, unnest({RQ.TOK.format(CC)}) t from dx), q as (select id query_id, left(({RQ.TOK.format('title')})[-1], 3) p from dx where id % 100 = 0) select query_id, id, count(*) n from x join q on starts_with(t, p) where p is not null group by 1, 2"),
    "R5_typed_section": (r5_typed, RQ.VEC + ", p as (select a.id query_id, b.id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) similarity from vectors a join vectors b on a.node_type = b.node_type and a.id <> b.id where a.id % 100 = 0) select query_id, id, (row_number() over (partition by query_id order by round(similarity, 9) desc, id))::int rank from p qualify rank <= 30"),
    "R10_issue_payload": (r10, R10),
    "G11_session_context": (g11, RQ.DOCS + f", se as (select session_id id, body from ({WQ.I0} select session_id, body from se))" + RQ.bm25_sql("dx", RQ.DTEXT, "body", 20, queries="se") + " select query_id, id, rank from hits"),
    "G14_session_ids": (g14, WQ.I0 + ", k as (select session_id, node_type q, count(distinct id) n, min(id) id from te group by 1, 2) select session_id, q as query, case when n = 1 then id end id, case when n = 1 then 'found' else 'ambiguous' end outcome from k"),
    "G15_commit_then_validate": (g15, f"select kind, count(*) n from (select kind from ({GQ.M1}) where severity = 'error' union all select 'skipped_edge' from (" + WQ.QUERIES["G6_commit_plan"][1] + ") where outcome = 'skipped') group by 1"),
    "G10_full_sync": (lambda s, d: W.full_sync(WQ.synced_nodes(s, d), WQ.issues(s, d), WQ.state(s, d)).groupBy("step", "action").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), G10),
    "G12_session_report": (lambda s, d: W.session_report(WQ.sessions(s, d), WQ.tentative(s, d), WQ.answers(s, d)), WQ.I0 + ", k as (select session_id, node_type, string_agg(id, ',' order by id) ids, count(*) filter (regexp_matches(body, '(?im)^\\s*needs:')) n_needs, min_by(array_to_string(string_split(body, chr(10))[1:3], chr(10)), id) preview from te group by 1, 2) select session_id, phase, node_type, ids, n_needs, preview, (select count(*) from an where an.session_id = se.session_id) n_answers from se join k using (session_id)"),
    "A20_store_sizes": (lambda s, d: W.store_sizes(B.raw(s, d, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("snapshot_key"), F.octet_length("html").cast("long").alias("length"), C("page_id").alias("modified"))), "select regexp_extract(url, '//([^/?#]+)', 1) snapshot_key, sum(strlen(html))::bigint bytes, count(*) n_files, max(page_id) modified from pages group by 1"),
    "S11_session_list": (lambda s, d: P.session_list(WQ.sessions(s, d), WQ.answers(s, d)), WQ.I0 + ", l as (select session_id, max(turn) t from an group by 1) select session_id, phase, (row_number() over (partition by phase order by t desc nulls last, session_id))::int place from se left join l using (session_id)"),
    "S6_json_lines": (lambda s, d: B.raw(s, d, "events").select(F.to_json(F.struct(F.concat(F.lit("e-"), "event_id").alias("id"), "ts", C("event_type").alias("kind"))).alias("line"), "event_id").select("event_id", F.from_json("line", "id string, ts timestamp, kind string").alias("e")).select("event_id", "e.id", "e.kind", F.date_format("e.ts", "yyyy-MM-dd HH:mm:ss").alias("ts")), "select event_id, 'e-' || event_id id, event_type kind, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from events"),
    "T7_task_events": (t7, "with x as (select *, lag(event_type) over (partition by user_id order by ts, event_id) prior from events) select user_id, event_id, case event_type when 'view' then 'plan' when 'purchase' then 'outcome' when 'error' then 'risk' end kind from x where prior <> event_type and event_type in ('view', 'purchase', 'error')"),
    "T10_checked": (lambda s, d: SJ.checked(B.view(s, d, "docs").select("id", C("title").alias("summary"), C("body").alias("detail"), F.when(C("node_type") == "en", "decision").otherwise("finding").alias("kind"))).select("id", "reason", F.sha2("detail", 256).alias("h")), D + ", x as (select id, title summary, body detail, case node_type when 'en' then 'decision' else 'finding' end kind from docs) select id, case when length(trim(summary)) < 20 then 'summary_short' when length(trim(summary)) > 200 then 'summary_long' when kind = 'decision' and length(trim(detail)) < 50 then 'detail_short' end reason, sha256(" + RED + ") h from x"),
    "T5_day_windows": (t5, E + "select strftime(ts, '%Y-%m-%d') as day, kind, count(*) n from entries group by 1, 2"),
    "T2_distinct_ids": (lambda s, d: B.view(s, d, "entries").unionByName(B.view(s, d, "entries").filter("kind = 'plan'")).dropDuplicates(["id"]).select("id", "kind"), E + "select id, kind from entries"),
}
