"""Registered queries of stored tables and of clauses over a positional index, each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import embed as E
from quillgraph.operators import maintain as M
from quillgraph.operators import postings as P
from quillgraph.plans import graph_queries as GQ
from quillgraph.plans import retrieval_queries as RQ
from quillgraph.plans import stem_sql
from quillgraph.plans.lineage import checkpoint, shared_folder
from quillgraph.sources import bindings as B
from quillgraph.sources import tables as ST

S = SparkSession
C = F.col
HASHED = ("id", "node_type", "status", "owner", "title", "body")


def _scratch(s: S) -> str:
    return f"{shared_folder(s)}/tables-{uuid.uuid4().hex}"


def _gone(s: S, path: str) -> None:
    p, files = ST._files(s, path)
    files.delete(p, True)


def indexed(nodes: DataFrame) -> DataFrame:
    return nodes.select(*HASHED).withColumn("index_hash", M.index_hash(*HASHED))


def stored_nodes(s: S, d: str) -> DataFrame:
    """A stored index of all nodes, built, left alone, brought up to a changed graph, and built anew for another schema:
    what each step did, and the rows by status that are stored in the end."""
    old = GQ.nodes(s, d)
    new = old.filter("not (node_type = 'component' and id like '%7')").withColumn("status", F.when(C("id").like("o-%3"), "draft").otherwise(C("status")))
    new = new.unionByName(old.filter("node_type = 'epic'").withColumn("id", F.concat(F.lit("new-"), "id")))
    path = _scratch(s)
    steps = [("build", "v1", old), ("same", "v1", old), ("changed", "v1", new), ("schema", "v2", new)]
    rows = [(name, kind, n) for name, schema, nodes in steps for kind, n in ST.refresh(s, path, schema, ["id"], indexed(nodes), "index_hash").items()]
    report = s.createDataFrame(rows, "step string, kind string, n long")
    stored = ST.read(s, path).groupBy(F.lit("stored").alias("step"), F.coalesce("status", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    out = checkpoint(report.unionByName(stored))
    _gone(s, path)
    return out


STORED = B.oracle("nodes") + """, new as (select id, case when id like 'o-%3' then 'draft' else status end status from nodes where not (node_type = 'component' and id like '%7')
  union all select 'new-' || id, status from nodes where node_type = 'epic'),
 k as (select case when o.id is null then 'added' when n.id is null then 'removed' when o.status is distinct from n.status then 'changed' else 'unchanged' end kind from nodes o full join new n on o.id = n.id),
 r as (
  select 'build' step, 'rebuilt' kind, 1 n union all select 'build', 'added', count(*) from nodes union all select 'same', 'unchanged', count(*) from nodes
  union all select 'changed', kind, count(*) from k group by 2 union all select 'schema', 'rebuilt', 1 union all select 'schema', 'added', count(*) from new),
 z as (select * from (values ('build'), ('same'), ('changed'), ('schema')) s(step), (values ('rebuilt'), ('added'), ('changed'), ('removed'), ('unchanged')) t(kind))
select step, kind, coalesce(n, 0)::bigint n from z left join r using (step, kind)
union all select 'stored', coalesce(status, 'none'), count(*) from new group by 2"""


def stored_vectors(s: S, d: str) -> DataFrame:
    """A stored table of vectors by content hash, filled from half of the documents, then from all: each step's report, and
    the contents whose vector is stored. Copies share a vector; only new contents are embedded."""
    docs = B.view(s, d, "docs").select("doc_id", F.sha2("body", 256).alias("content_hash"), C("body").alias("text")).filter("content_hash is not null")
    path, model = _scratch(s), E.HashedWords()
    none = s.createDataFrame([], "content_hash string, model string")

    def vectors(rows: DataFrame) -> DataFrame:
        return E.fill(none, rows.select("content_hash", "text"), model).withColumn("state", C("content_hash"))

    rows = []
    for step, part in (("half", docs.filter("doc_id % 2 = 0")), ("all", docs)):
        source = part.groupBy("content_hash").agg(F.first("text").alias("text")).withColumn("state", C("content_hash"))
        rows += [(step, kind, n) for kind, n in ST.refresh(s, path, model.fingerprint, ["content_hash"], source, "state", vectors).items()]
    stored = ST.read(s, path).agg(F.count(F.lit(1)).alias("n")).select(F.lit("stored").alias("step"), F.lit("contents").alias("kind"), "n")
    out = checkpoint(s.createDataFrame(rows, "step string, kind string, n long").unionByName(stored))
    _gone(s, path)
    return out


VECTORS = B.oracle("docs") + """, h as (select count(distinct sha256(body)) filter (doc_id % 2 = 0) a, count(distinct sha256(body)) b from docs)
select step, kind, n::bigint n from h, lateral (select * from (values ('half', 'rebuilt', 1), ('half', 'added', a), ('half', 'changed', 0), ('half', 'removed', 0), ('half', 'unchanged', 0), ('all', 'rebuilt', 0), ('all', 'added', b - a), ('all', 'changed', 0), ('all', 'removed', 0), ('all', 'unchanged', a), ('stored', 'contents', b)) v(step, kind, n))"""


def clauses(s: S, d: str) -> DataFrame:
    """A query for every hundredth document: its title's first two words as a phrase in titles or bodies, or its first and third
    near each other in the body, with the last word's beginning, and without the title's fifth word."""
    rows = P.exploded(P.documents(RQ.docs(s, d).filter("doc_id % 100 = 0").select("id", "title"), "title", positional=True))
    t = rows.select("id", "term", F.explode("positions").alias("p")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("t")).filter(F.size("t") > 2)
    word = lambda n: F.array_compact(F.array(F.get("t", F.lit(n))))
    clause = lambda n, role, kind, terms, field, gap: F.struct(F.lit(n).alias("clause"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), terms.alias("terms"), F.lit(field).cast("int").alias("field"), F.lit(gap).alias("gap"))
    each = F.array(
        clause(0, "should", "phrase", F.slice("t", 1, 2), None, 0),
        clause(1, "should", "near", F.array_distinct(F.array(F.get("t", F.lit(0)), F.get("t", F.lit(2)))), 1, 3),
        clause(2, "must", "prefix", F.array(F.left(F.element_at("t", -1), F.lit(1))), None, 0),
        clause(3, "never", "all", word(4), None, 0),
    )
    return t.select(C("id").alias("query_id"), F.explode(each).alias("c")).select("query_id", "c.*")


def matched(s: S, d: str) -> DataFrame:
    return P.match(P.build(RQ.docs(s, d), "title", "body", positional=True), clauses(s, d))


MATCHED = RQ.DOCS + f""", cx as materialized (select id, {RQ.WORDS.format("title")} t, {RQ.WORDS.format("body")} b from dx),
 raw as (select distinct t from (select unnest(t) t from cx union all select unnest(b) from cx)),
 {stem_sql.stems("raw", "voc")},
 tw as (select id, list(voc.w order by i) t from (select id, unnest(t) t, unnest(range(len(t))) i from cx) join voc using (t) group by 1),
 bw as (select id, list(voc.w order by i) b from (select id, unnest(b) t, unnest(range(len(b))) i from cx) join voc using (t) group by 1),
 x as materialized (
  select cx.id, coalesce(tw.t, []) t, coalesce(bw.b, []) b, ' ' || array_to_string(coalesce(tw.t, []), '  ') || ' ' ts, ' ' || array_to_string(coalesce(bw.b, []), '  ') || ' ' bs
  from cx left join tw using (id) left join bw using (id))""" + """,
 q as materialized (select id query_id, t[1] a, t[2] c, t[3] e, left(t[-1], 1) p, t[5] v from x where id % 100 = 0 and len(t) > 2)
select query_id, id from q, x
where (contains(ts, ' ' || a || '  ' || c || ' ') or contains(bs, ' ' || a || '  ' || c || ' ')
   or len(list_filter(range(1, len(b) + 1), lambda i: (b[i] = a and list_contains(b[i:i + 4], e)) or (b[i] = e and list_contains(b[i:i + 4], a)))) > 0)
  and len(list_filter(list_concat(t, b), lambda w: starts_with(w, p))) > 0 and (v is null or not list_contains(list_concat(t, b), v))"""

QUERIES = {
    "S5_stored_index": (stored_nodes, STORED),
    "S10_stored_vectors": (stored_vectors, VECTORS),
    "K6_match": (matched, MATCHED),
}
