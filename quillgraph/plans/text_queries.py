"""Registered queries of the column functions, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.stem import stems
from quillgraph.operators import journal as J
from quillgraph.operators import maintain as M
from quillgraph.operators import reports as P
from quillgraph.plans import stem_sql
from quillgraph.sources import bindings as B

S = SparkSession
C = F.col
N, D, E = B.oracle("nodes"), B.oracle("docs"), B.oracle("entries")


def nodes(s: S, d: str) -> DataFrame:
    return B.view(s, d, "nodes")


def docs(s: S, d: str) -> DataFrame:
    return B.view(s, d, "docs")


def events(s: S, d: str) -> DataFrame:
    return B.raw(s, d, "events")


def ids(s: S, d: str) -> DataFrame:
    """Ids with and without a suffix, some with a type in front."""
    h = F.substring(F.md5(C("id").cast("binary")), 1, 6)
    return nodes(s, d).select("id", F.concat(F.when(C("id").like("%1"), "feature-").when(C("id").like("%2"), "feature-request-").otherwise(""), F.replace("id", F.lit("_"), F.lit("-")), F.lit("-"), F.when(C("id").like("%5"), F.lit("il")).otherwise(h)).alias("full"))


IDS = N + ", x as (select id, case when id like '%1' then 'feature-' when id like '%2' then 'feature-request-' else '' end || id || '-' || case when id like '%5' then 'il' else substr(md5(id), 1, 6) end as full_id from nodes)"
FIRST = "coalesce(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: trim(x) <> '')[1], '')"
LINE1 = f"trim(regexp_replace({FIRST}, '^\\s*#+\\s*', ''))"
COS = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::double * b[i]::double))"


def p6(s: S, d: str) -> DataFrame:
    """Ids for all nodes from their titles; slugs that repeat are told apart by the suffix alone."""
    made = M.auto_ids(nodes(s, d).select(C("id").alias("draft"), "title"), nodes(s, d), "draft")
    return made.groupBy(F.regexp_extract("id", "^(.*)-[0-9a-hjkmnp-tv-z]{6}$", 1).alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


def p21(s: S, d: str) -> DataFrame:
    v = B.view(s, d, "vectors")
    other = v.select((C("id") + 1).alias("id"), C("embedding").alias("b"))
    return v.join(other, "id").select("id", F.round(T.cosine(C("embedding"), C("b")), 6).alias("cosine"))


def p23(s: S, d: str) -> DataFrame:
    """Rule hits over documents, by rule."""
    rules = {**T.SECRET_RULES, **T.CORPUS_RULES}
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias("found")) for n, p in rules.items()])
    one = docs(s, d).select("id", F.explode(hits).alias("h")).select("id", "h.rule", F.explode("h.found").alias("found"))
    return one.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_docs"), F.min("found").alias("least"))


def rules_sql() -> str:
    rows = " union all ".join(f"select id, '{n}' as rule, unnest(regexp_extract_all(body, '{p.replace(chr(39), chr(39) * 2)}')) found from docs" for n, p in {**T.SECRET_RULES, **T.CORPUS_RULES}.items())
    return D + f", h as ({rows}) select rule, count(*) n, count(distinct id) n_docs, min(found) least from h group by 1"


def redact_sql() -> str:
    out = "body"
    for n, p in {**T.SECRET_RULES, **T.CORPUS_RULES}.items():
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '<REDACTED:{n}>', 'g')"
    return D + f"select id, sha256({out}) redacted from docs"


def p24(s: S, d: str) -> DataFrame:
    runs = docs(s, d).select("id", F.explode(T.entropy_runs(C("body"), 3.0)).alias("run"))
    return runs.withColumn("bits", F.round(T.entropy(C("run")), 6))


#: Bits a character from which the corpus queries take a run for a secret; hexadecimal keys have at most 4.
CORPUS_BITS = 3.0


def p25_block(s: S, d: str) -> DataFrame:
    """P25: the documents that block mode stops, and why."""
    out = J.enforce(docs(s, d), "block", ("title", "body"), {**T.SECRET_RULES, **T.CORPUS_RULES}, CORPUS_BITS)
    return out.filter("blocked is not null").select("id", "blocked.rule", "blocked.field", F.size("matches").cast("long").alias("n"))


def block_sql() -> str:
    rules = list({**T.SECRET_RULES, **T.CORPUS_RULES}.items())
    rows = " union all ".join(f"select id, {f} f, {k} k, unnest(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}')) m from docs" for f, c in enumerate(("title", "body")) for k, (_, p) in enumerate(rules))
    runs = " union all ".join(f"select id, {f} f, unnest(regexp_extract_all({c}, '[A-Za-z0-9_+/=-]{{24,}}')) m from docs" for f, c in enumerate(("title", "body")))
    names = ", ".join(f"({k}, '{n}')" for k, n in enumerate([*(n for n, _ in rules), T.ENTROPY_RULE]))
    bits = "-list_sum(list_transform(list_distinct(string_split(m, '')), lambda x: len(list_filter(string_split(m, ''), lambda y: y = x)) / length(m)::double * log2(len(list_filter(string_split(m, ''), lambda y: y = x)) / length(m)::double)))"
    return D + f""", h as ({rows} union all select id, f, {len(rules)}, m from ({runs}) where {bits} >= {CORPUS_BITS}),
 b as (select id, min((f, k)) x, count(*) n from h group by 1)
select id, name as rule, case x[1] when 0 then 'title' else 'body' end field, n from b join (values {names}) v(k, name) on k = x[2]"""


def p29(s: S, d: str) -> DataFrame:
    said = F.concat(F.col("event_type"), F.when(C("event_id") % 3 == 0, "s").otherwise(""))
    typed = events(s, d).select("event_id", F.when(C("event_id") % 4 == 0, "decison").when(C("event_id") % 4 == 1, "findings").when(C("event_id") % 4 == 2, "plan").otherwise(said).alias("said"))
    return typed.select("event_id", T.nearest_kind(C("said")).alias("kind"))


KINDS = ", ".join(f"('{k}')" for k in T.KINDS)
P29 = f"""with t as (select event_id, case event_id % 4 when 0 then 'decison' when 1 then 'findings' when 2 then 'plan' else event_type || case when event_id % 3 = 0 then 's' else '' end end said from events),
 u as (select said, min_by(k, (levenshtein(said, k), k)) k, min(levenshtein(said, k)) far from (select distinct said from t), (values {KINDS}) v(k) group by 1)
select event_id, case when far <= 3 then k end kind from t join u using (said)"""

P33 = "case when node_type = 'feature' then case status when 'draft' then 'Backlog' when 'active' then 'In Progress' when 'completed' then 'Done' when 'superseded' then 'Canceled' when 'archived' then 'Canceled' end when node_type = 'epic' then case status when 'draft' then 'planned' when 'active' then 'started' when 'completed' then 'completed' when 'archived' then 'canceled' end end"


def p33_back(s: S, d: str) -> DataFrame:
    """Remote states, some in other cases and some of other names, back to statuses."""
    own, end = P.remote_state(C("node_type"), C("status")), F.right("id", F.lit(1))
    state = F.when(end == "1", F.upper(own)).when(end == "2", "Triage").when(end == "3", "CANCELLED").when(end == "4", "paused").otherwise(own)
    return nodes(s, d).select("id", "node_type", state.alias("state")).select("id", "state", P.local_status(C("node_type"), C("state")).alias("status"))


QUERIES = {
    "P1_title": (lambda s, d: nodes(s, d).select("id", T.title(C("body"), C("id")).alias("title")), N + "select id, coalesce(nullif(trim(regexp_extract(body, '(?m)^(?:# )+(.*)$', 1)), ''), id) title from nodes"),
    "P2_content_hash": (lambda s, d: docs(s, d).select("id", T.content_hash(C("body")).alias("content_hash")), D + "select id, sha256(body) content_hash from docs"),
    "P3_index_hash": (lambda s, d: nodes(s, d).select(M.index_hash("node_type", "status", "owner").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("n"), N + "select count(*) n from nodes group by node_type, status, owner"),
    "P4_parse_id": (lambda s, d: ids(s, d).select("id", T.id_slug(C("full")).alias("slug"), T.id_suffix(C("full")).alias("suffix")), IDS + " select id, regexp_extract(full_id, '^(.+)-([0-9a-hjkmnp-tv-z]{6})$', 1) slug, regexp_extract(full_id, '^(.+)-([0-9a-hjkmnp-tv-z]{6})$', 2) suffix from x"),
    "P5_strip_prefix": (lambda s, d: ids(s, d).select("id", T.strip_prefix(C("full"), ["feature", "feature-request", "task"]).alias("bare")), IDS + " select id, case when starts_with(full_id, 'feature-request-') then substr(full_id, 17) when starts_with(full_id, 'feature-') then substr(full_id, 9) else full_id end bare from x"),
    "P6_make_suffix": (p6, N + ", x as (select replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ', '-') j from nodes) select case when length(j) <= 50 then j when contains(left(j, 51), '-') then regexp_replace(left(j, 51), '-[^-]*$', '') else left(j, 50) end slug, count(*) n, count(*) n_ids from x group by 1"),
    "P8_body_section": (lambda s, d: nodes(s, d).select("id", T.body_section(C("body"), "Notes").alias("section")), N + "select id, case when contains(body, chr(10) || '## Notes' || chr(10)) then trim(split_part(body, '## Notes' || chr(10), 2)) end section from nodes"),
    "P9_first_paragraph": (lambda s, d: nodes(s, d).select("id", F.sha2(T.without_title(C("body")), 256).alias("rest"), T.first_paragraph(C("body"), 20).alias("lead")), N + ", x as (select id, regexp_replace(body, '^# [^\\n]*\\n*', '') r from nodes), y as (select id, r, trim(regexp_replace(split_part(r, chr(10) || '##', 1), '\\s+$', '')) p from x) select id, sha256(r) rest, case when length(p) > 20 then left(p, 17) || '...' else p end lead from y"),
    "P10_body_summary": (lambda s, d: docs(s, d).select("id", T.body_summary(C("body"), 40).alias("summary")), D + r""", l as (select id, regexp_split_to_array(coalesce(body, ''), '\r?\n') l from docs),
 a as (select id, l[list_position(list_transform(l, lambda x: not starts_with(x, '#') and regexp_matches(x, '[^\s\p{Z}\x0B\x85]')), true):] l from l where list_contains(list_transform(l, lambda x: not starts_with(x, '#') and regexp_matches(x, '[^\s\p{Z}\x0B\x85]')), true)),
 b as (select id, list_position(list_transform(l, lambda x: regexp_matches(x, '[^\s\p{Z}\x0B\x85]')), false) e, l from a),
 t as (select docs.id, coalesce(array_to_string(case when e > 0 then l[:e - 1] else l end, ' '), '') t from docs left join b using (id))
select id, case when length(t) <= 40 then t else regexp_replace(left(t, 40), ' [^ ]*$', '') || '...' end summary from t"""),
    "P11_first_line": (lambda s, d: docs(s, d).select("id", T.first_line(C("body")).alias("line")), D + f"select id, {LINE1} line from docs"),
    "P12_slug": (lambda s, d: docs(s, d).select("id", T.slug(C("title")).alias("slug")), D + ", x as (select id, replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ', '-') j from docs) select id, case when length(j) <= 50 then j when contains(left(j, 51), '-') then regexp_replace(left(j, 51), '-[^-]*$', '') else left(j, 50) end slug from x"),
    "P12_slug_words": (lambda s, d: docs(s, d).select("id", T.slug_words(C("title")).alias("slug")), D + ", x as (select id, coalesce(nullif(trim(regexp_replace(title, '^\\s*#+\\s*', '')), ''), 'untitled') l from docs) select id, left(replace(trim(regexp_replace(lower(l), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ', '-'), 50) slug from x"),
    "P12_typed_slug": (lambda s, d: nodes(s, d).select("id", T.typed_slug(C("body"), C("node_type")).alias("slug")), N + ", x as (select id, case node_type when 'feature' then 'feat' else node_type end p, replace(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ', '-') j from nodes) select id, p || '-' || case when length(j) <= 50 then j when contains(left(j, 50), '-') then regexp_replace(left(j, 50), '-[^-]*$', '') else left(j, 50) end slug from x"),
    "P13_whole_titles": (lambda s, d: docs(s, d).select("id", F.array_join(T.query_terms(C("title")), "|").alias("terms")), D + "select id, array_to_string(list_filter(list_transform(regexp_split_to_array(title, '\\s+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}_-]', '', 'g')), lambda t: t <> ''), '|') terms from docs"),
    "P14_tokens": (lambda s, d: docs(s, d).select(F.explode(T.tokens(C("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), D + "select term, count(*) n from (select unnest(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) term from docs) group by 1"),
    "P14_stems": (lambda s, d: stems(docs(s, d)).groupBy("stem").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")), D + ", k as materialized (select id, unnest(list_filter(regexp_split_to_array(lower(coalesce(body, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) t from docs), r as (select distinct t from k), " + stem_sql.stems("r", "voc") + " select w stem, count(*) tf, count(distinct id) df from k join voc using (t) group by 1"),
    "P17_recency": (lambda s, d: events(s, d).select("event_id", F.round(T.recency(C("ts"), F.lit("2024-01-15").cast("timestamp")), 6).alias("recency")), "select event_id, round(case when ts >= timestamp '2024-01-15' then 0.5 else 0.5 * pow(2.0, -(epoch(timestamp '2024-01-15') - floor(epoch(ts))) / 86400.0 / 14.0) end, 6)::double recency from events"),
    "P18_kind_boost": (lambda s, d: B.view(s, d, "entries").select("id", T.kind_boost(C("kind")).alias("boost")), E + "select id, (case kind when 'decision' then 0.5 when 'dead_end' then 0.5 when 'finding' then 0.3 when 'outcome' then 0.2 when 'assumption' then -0.1 else 0.0 end)::double boost from entries"),
    "P19_dedup_key": (lambda s, d: docs(s, d).select("id", F.sha2(T.dedup_key(C("body")), 256).alias("k")), D + "select id, sha256(lower(trim(regexp_replace(body, '\\s+', ' ', 'g')))) k from docs"),
    "P20_costs": (lambda s, d: docs(s, d).select("id", T.node_tokens(C("title"), C("body")).alias("tokens"), T.summary_cost(C("title")).alias("cost")), D + "select id, (strlen(title) + strlen(body)) // 4 as tokens, length(title) // 4 + 1 as cost from docs"),
    "P21_cosine": (p21, f"select id, round({COS} / (sqrt({COS.replace('b[', 'a[')}) * sqrt({COS.replace('a[', 'b[').replace('len(a)', 'len(b)')})), 6) cosine from (select v.vec_id id, v.embedding a, w.embedding b from embeddings v join embeddings w on w.vec_id + 1 = v.vec_id)"),
    "P23_rule_hits": (p23, rules_sql()),
    "P24_high_entropy": (p24, D + ", r as (select id, unnest(regexp_extract_all(body, '[A-Za-z0-9_+/=-]{24,}')) run from docs), c as (select id, run, list_transform(list_distinct(string_split(run, '')), lambda x: len(list_filter(string_split(run, ''), lambda y: y = x)) / length(run)::double) p from r) select id, run, round(-list_sum(list_transform(p, lambda x: x * log2(x))), 6) bits from c where round(-list_sum(list_transform(p, lambda x: x * log2(x))), 6) >= 3.0"),
    "P25_redact": (lambda s, d: docs(s, d).select("id", F.sha2(T.redact(C("body"), {**T.SECRET_RULES, **T.CORPUS_RULES}), 256).alias("redacted")), redact_sql()),
    "P25_block": (p25_block, block_sql()),
    "P26_clamp": (lambda s, d: docs(s, d).select("id", T.clamp(C("body")).alias("clamped")), D + "select id, case when length(body) > 200 then left(body, 193) || ' […cut]' else body end clamped from docs"),
    "P27_archive_path": (lambda s, d: events(s, d).select("event_id", T.archive_path(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), F.substring(F.md5(C("user_id").cast("string").cast("binary")), 1, 8), F.lit("-"), F.when(C("event_id") % 9 == 0, "x").otherwise(F.date_format("ts", "HHmmss")))).alias("path")), "with x as (select event_id, ts, strftime(ts, '%Y%m%d') || '-' || substr(md5(user_id::varchar), 1, 8) || '-' || case when event_id % 9 = 0 then 'x' else strftime(ts, '%H%M%S') end s from events) select event_id, case when event_id % 9 <> 0 then 'archive/' || strftime(ts, '%Y/%m/%d') || '/' || s end path from x"),
    "P28_relative_path": (lambda s, d: events(s, d).select("event_id", T.relative_path(F.concat(F.when(C("event_id") % 2 == 0, "/repo/").otherwise("./"), F.lit("src\\f"), C("user_id"), F.lit(".py")), "/repo").alias("path")), "select event_id, 'src/f' || user_id || '.py' path from events"),
    "P29_nearest_kind": (p29, P29),
    "P30_age": (lambda s, d: events(s, d).select("event_id", T.age((C("event_id") * 37 % 300000)).alias("age")), "select event_id, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' when s < 86400 then s // 3600 || 'h' else s // 86400 || 'd' end age from (select event_id, event_id * 37 % 300000 s from events)"),
    "P31_parse_size": (lambda s, d: events(s, d).select("event_id", T.parse_size(F.concat(C("user_id").cast("string"), F.element_at(F.array(*map(F.lit, ["", "K", "m", "G", "x"])), (C("event_id") % 5 + 1).cast("int")))).alias("bytes")), "select event_id, case event_id % 5 when 0 then user_id when 1 then user_id * 1024 when 2 then user_id * 1048576 when 3 then user_id * 1073741824 end::bigint bytes from events"),
    "P32_needs": (lambda s, d: nodes(s, d).filter(T.needs_marker(C("body"))).select("id"), N + "select id from nodes where regexp_matches(body, '(?im)^\\s*needs:')"),
    "P33_status_map": (lambda s, d: nodes(s, d).select("id", P.remote_state(C("node_type"), C("status")).alias("state")), N + f"select id, {P33} state from nodes"),
    "P33_local_status": (p33_back, N + f", r as (select id, node_type, case right(id, 1) when '1' then upper({P33}) when '2' then 'Triage' when '3' then 'CANCELLED' when '4' then 'paused' else {P33} end state from nodes) select id, state, case when node_type = 'feature' then case when lower(state) in ('backlog', 'triage') then 'draft' when lower(state) in ('in progress', 'started') then 'active' when lower(state) in ('done', 'completed') then 'completed' when lower(state) in ('canceled', 'cancelled', 'duplicate') then 'superseded' end when node_type = 'epic' then case when lower(state) in ('planned', 'backlog') then 'draft' when lower(state) in ('started', 'in progress', 'paused') then 'active' when lower(state) in ('completed', 'done') then 'completed' when lower(state) in ('canceled', 'cancelled') then 'archived' end end status from r"),
    "P34_fields": (lambda s, d: P.fields(nodes(s, d), ("status", "owner", "updated")), N + "select id, 'status' field, status as value from nodes where status is not null union all select id, 'owner', owner from nodes where owner is not null union all select id, 'updated', strftime(updated, '%Y-%m-%d') from nodes where updated is not null"),
    "P35_embedding_text": (lambda s, d: nodes(s, d).select("id", F.sha2(T.embedding_text(C("title"), C("body")), 256).alias("h")), N + "select id, sha256(title || chr(10) || chr(10) || body) h from nodes"),
    "P37_directory": (lambda s, d: P.node_paths(nodes(s, d), B.node_types(s)), B.oracle("nodes", "node_types") + "select id, directory || '/' || id || '.md' file_path from nodes join node_types using (node_type)"),
}
