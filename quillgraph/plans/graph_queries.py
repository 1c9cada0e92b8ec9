"""Registered queries over the graph views, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import maintain as M
from quillgraph.operators import reports as P
from quillgraph.sources import bindings as B

S = SparkSession
DAY = "1995-06-17"


def nodes(s: S, d: str) -> DataFrame:
    return B.view(s, d, "nodes")


def edges(s: S, d: str) -> DataFrame:
    return B.view(s, d, "edges")


def near(s: S, d: str, mode: Callable[[DataFrame], DataFrame] = lambda e: e) -> Callable[[Callable[[DataFrame], DataFrame]], DataFrame]:
    """The edges of the sources that a filter leaves in, for traversals."""
    return lambda keep: mode(B.edges(s, d, keep))


def schema(s: S) -> tuple[DataFrame, DataFrame, DataFrame]:
    return B.node_types(s), B.allowed_edges(s), B.edge_types(s)


def strings(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines return one type."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_until") if c in df.columns})


E_COLS = ("source_id", "edge_idx", "target_id", "edge_type", "valid_from", "valid_until")
E_SQL = "source_id, edge_idx, target_id, edge_type, valid_from::varchar valid_from, valid_until::varchar valid_until"
AS_OF = f"(valid_from is null or valid_from <= date '{DAY}') and (valid_until is null or valid_until > date '{DAY}')"
KNOWN = "target_id in (select id from nodes)"

TRIPLES = """
 flat as (select s.node_type source_type, a.edge_type, t.node_type target_type from allowed_edges a
   join node_types s on a.source_type = '*' or a.source_type = s.node_type join node_types t on a.target_type = '*' or a.target_type = t.node_type),
 triples as (select * from flat union select target_type, reverse, source_type from flat join edge_types using (edge_type)),
 typed as (select e.*, s.node_type source_type, t.node_type target_type from edges e join nodes s on s.id = source_id join nodes t on t.id = target_id),
 bad as (select * from typed anti join triples using (source_type, edge_type, target_type)),
 known as (select e.*, reverse from edges e join edge_types using (edge_type) semi join nodes n on n.id = e.target_id),
 lacking as (select * from known e anti join edges b on b.source_id = e.target_id and b.target_id = e.source_id and b.edge_type = e.reverse)"""
FULL = B.oracle("nodes", "edges", "node_types", "allowed_edges", "edge_types")

M1 = f"""{FULL}, {TRIPLES}
select 'unknown_type' kind, 'error' severity, id node_id, node_type detail from nodes where node_type not in (select node_type from node_types)
union all select 'missing_field', 'error', id, 'status' from nodes join node_types using (node_type) where list_contains(required, 'status') and status is null
union all select 'missing_field', 'error', id, 'owner' from nodes join node_types using (node_type) where list_contains(required, 'owner') and owner is null
union all select 'bad_status', 'error', id, status from nodes join node_types using (node_type) where status is not null and len(statuses) > 0 and not list_contains(statuses, status)
union all select 'dangling_edge', 'error', source_id, edge_type || ' -> ' || target_id from edges where target_id not in (select id from nodes)
union all select 'disallowed_edge', 'error', source_id, edge_type || ' -> ' || target_id from bad
union all select 'missing_reverse', 'warning', source_id, edge_type || ' -> ' || target_id from lacking
"""


def m1(s: S, d: str) -> DataFrame:
    return M.validate(nodes(s, d), edges(s, d), *schema(s))


def m2(s: S, d: str) -> DataFrame:
    return strings(M.repair(nodes(s, d), edges(s, d), B.edge_types(s))).select(*E_COLS)


M2 = f"""{FULL}, {TRIPLES},
 whole as (select source_id, target_id, edge_type, valid_from, valid_until from edges union all
   select distinct target_id, source_id, reverse, null::date, null::date from lacking)
select source_id, (row_number() over (partition by source_id order by target_id, edge_type, valid_from nulls first) - 1)::int edge_idx, target_id, edge_type, valid_from::varchar valid_from, valid_until::varchar valid_until from whole
"""


def j6(s: S, d: str) -> DataFrame:
    roots = B.raw(s, d, "orders").select(F.concat(F.lit("o-"), "o_orderkey").alias("root_id"), F.date_add(F.to_date("o_orderdate"), F.pmod("o_orderkey", F.lit(400)).cast("int")).alias("day"))
    return G.as_of_join(roots, edges(s, d)).groupBy("root_id", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("first_target"))


J6 = B.oracle("edges") + """
select root_id, day::varchar as day, count(*) n, min(target_id) first_target
from (select 'o-' || o_orderkey root_id, o_orderdate::date + (o_orderkey % 400)::int as day from orders) r join edges on root_id = source_id
where (valid_from is null or valid_from <= day) and (valid_until is null or valid_until > day) group by all
"""


def roots(s: S, d: str) -> DataFrame:
    """The roots of traversals: every order whose key is divisible by 100."""
    return B.raw(s, d, "orders").filter(F.col("o_orderkey") % 100 == 0).select(F.concat(F.lit("o-"), "o_orderkey").alias("root_id"))


def bfs_sql(depth: int, types: tuple[str, ...] = (), where: str = "true") -> str:
    """Breadth-first search unrolled to ``depth`` levels."""
    chosen = f"edge_type in ({', '.join(map(repr, types))})" if types else "true"
    rank = ("case edge_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(types)) + " end") if types else "0"
    sql = B.oracle("nodes", "edges") + f""",
 e as (select source_id, target_id, {rank} tp, edge_idx from edges where {chosen} and {where} and {KNOWN}),
 l0 as (select 'o-' || o_orderkey root_id, 'o-' || o_orderkey id, 0 depth, 0 pos, ['o-' || o_orderkey] path from orders where o_orderkey % 100 = 0)"""
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select root_id, id from l{j}" for j in range(k))
        sql += f""",
 c{k} as (select root_id, target_id id, pos, tp, edge_idx, path, row_number() over (partition by root_id, target_id order by pos, tp, edge_idx) rn
   from l{k - 1} l join e on e.source_id = l.id where (root_id, target_id) not in ({seen})),
 l{k} as (select root_id, id, {k} depth, (row_number() over (partition by root_id order by pos, tp, edge_idx, id))::int pos, list_append(path, id) path from c{k} where rn = 1)"""
    return sql + ",\n reached as (" + " union all ".join(f"select * from l{j}" for j in range(depth + 1)) + ")\n"


HOP = "case depth when 0 then 1.0 when 1 then 0.8 when 2 then 0.5 else greatest(0.3, 0.5 - 0.1 * (depth - 2)) end"
PATHS = "root_id, id, depth, pos, array_to_string(path, '>') path"


def paths(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", ">"))


def m3(s: S, d: str) -> DataFrame:
    o = B.raw(s, d, "orders")
    wanted = o.select(F.concat(F.lit("o-"), "o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, "uses").otherwise("serves").alias("edge_type"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "c-").otherwise("p-"), (F.col("o_orderkey") % 1999).cast("string")).alias("target_id"))
    return M.add_edges(nodes(s, d), edges(s, d), wanted, B.edge_types(s), M.permitted(*schema(s)))


M3 = f"""{FULL}, {TRIPLES},
 w as (select 'o-' || o_orderkey source_id, case when o_orderkey % 3 = 0 then 'uses' else 'serves' end edge_type, case when o_orderkey % 2 = 0 then 'c-' else 'p-' end || (o_orderkey % 1999) target_id from orders)
select w.source_id, w.edge_type, w.target_id, reverse,
  case when sn.id is null then 'no_source' when tn.id is null then 'no_target' when tr.edge_type is null then 'not_allowed' when ex.source_id is not null then 'duplicate' else 'added' end outcome
from w left join nodes sn on sn.id = w.source_id left join nodes tn on tn.id = w.target_id
left join triples tr on tr.source_type = sn.node_type and tr.edge_type = w.edge_type and tr.target_type = tn.node_type
left join (select distinct source_id, edge_type, target_id from edges) ex on ex.source_id = w.source_id and ex.edge_type = w.edge_type and ex.target_id = w.target_id
left join edge_types et on et.edge_type = w.edge_type
"""


def m4(s: S, d: str) -> DataFrame:
    e = edges(s, d)
    out = M.remove_edges(e, e.filter("edge_type = 'uses' and valid_until is not null"), B.edge_types(s))
    return out.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first_source"))


M4 = f"""{FULL}, u as (select source_id, edge_type, target_id from edges where edge_type = 'uses' and valid_until is not null)
select edge_type, count(*) n, min(source_id) first_source from edges e
where not exists (select 1 from u where u.source_id = e.source_id and u.edge_type = e.edge_type and u.target_id = e.target_id)
  and not (edge_type = 'used_by' and exists (select 1 from u where u.target_id = e.source_id and u.source_id = e.target_id)) group by 1
"""


def m5(s: S, d: str) -> DataFrame:
    names = B.raw(s, d, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("old_id"), F.concat(F.lit("part-"), "p_partkey").alias("new_id"))
    _, e = M.rename(nodes(s, d), edges(s, d), names)
    return e.select("source_id", "target_id", "edge_type")


M5 = B.oracle("edges") + """, m as (select 'p-' || p_partkey o, 'part-' || p_partkey n from part)
select coalesce(a.n, source_id) source_id, coalesce(b.n, target_id) target_id, edge_type from edges left join m a on a.o = source_id left join m b on b.o = target_id
"""


def m6(s: S, d: str) -> DataFrame:
    fresh = B.raw(s, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "p-").otherwise("x-"), "p_partkey").alias("id"), F.lit("component").alias("node_type"))
    return M.create_nodes(nodes(s, d), fresh)


def m7(s: S, d: str) -> DataFrame:
    changes = B.raw(s, d, "orders").select(F.concat(F.lit("o-"), (F.col("o_orderkey") + 7)).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "banana").otherwise("completed").alias("new_status"))
    return M.update_status(nodes(s, d), changes, B.node_types(s))


M7 = f"""{FULL}
select c.id, new_status, status prior, case when n.id is null then 'no_node' when t.statuses is not null and len(t.statuses) > 0 and not list_contains(t.statuses, new_status) then 'not_allowed' else 'updated' end outcome
from (select 'o-' || (o_orderkey + 7) id, case when o_orderkey % 4 = 0 then 'banana' else 'completed' end new_status from orders) c
left join nodes n using (id) left join node_types t using (node_type)
"""


def m8(s: S, d: str) -> DataFrame:
    changes = B.raw(s, d, "orders").select(F.concat(F.lit("o-"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "changed body").alias("body"), F.when(F.col("o_orderkey") % 5 == 0, "new owner").alias("owner"))
    return M.update_nodes(nodes(s, d), changes).select("id", "owner", "content_hash")


def m9(s: S, d: str) -> DataFrame:
    old = nodes(s, d).withColumn("index_hash", M.index_hash("id", "node_type", "status", "owner", "title", "body"))
    new = old.filter("not (node_type = 'component' and id like '%7')").withColumn("status", F.when(F.col("id").like("o-%3"), "draft").otherwise(F.col("status")))
    new = new.unionByName(old.filter("node_type = 'epic'").withColumn("id", F.concat(F.lit("new-"), "id")))
    new = new.withColumn("index_hash", M.index_hash("id", "node_type", "status", "owner", "title", "body"))
    return M.index_changes(old, new)


M9 = B.oracle("nodes") + """, new as (select id, case when id like 'o-%3' then 'draft' else status end status from nodes where not (node_type = 'component' and id like '%7')
  union all select 'new-' || id, status from nodes where node_type = 'epic')
select coalesce(o.id, n.id) id, case when o.id is null then 'insert' when n.id is null then 'delete' when o.status is distinct from n.status then 'replace' else 'keep' end as action from nodes o full join new n on o.id = n.id
"""


def m11(s: S, d: str) -> DataFrame:
    n, e = M.migrate(nodes(s, d), edges(s, d), {"vendor": "decision"}, {("feature", "banana"): "draft"}, {"uses": "consumes"}, {"owner": "nobody"})
    a = n.groupBy("node_type", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("owner") == "nobody").alias("n_default"))
    b = e.groupBy(F.col("edge_type").alias("node_type")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b.withColumns({"status": F.lit(None).cast("string"), "n_default": F.lit(0).cast("long")}))


M11 = B.oracle("nodes", "edges") + """
select case when node_type = 'vendor' then 'decision' else node_type end node_type, case when node_type = 'feature' and status = 'banana' then 'draft' else status end status, count(*) n, count(*) filter (owner is null) n_default from nodes group by 1, 2
union all select case when edge_type = 'uses' then 'consumes' else edge_type end, null, count(*), 0 from edges group by 1
"""


def m17(s: S, d: str) -> DataFrame:
    n, e = M.delete_nodes(nodes(s, d), edges(s, d), B.raw(s, d, "part").filter("p_size <= 5").select(F.concat(F.lit("p-"), "p_partkey").alias("id")))
    return G.dangling(n, e).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


M17 = B.oracle("nodes", "edges") + """, g as (select 'p-' || p_partkey id from part where p_size <= 5)
select edge_type, count(*) n from edges where source_id not in (select id from g) and (target_id not in (select id from nodes) or target_id in (select id from g)) group by 1
"""


def resolve(s: S, d: str) -> DataFrame:
    """Queries that are a whole id, a file name, or the number after a type letter."""
    q = B.raw(s, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("components/p-"), "p_partkey", F.lit(".md"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p-"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("query"))
    return G.resolve(q, nodes(s, d).withColumn("file_path", F.concat(F.lit("any/"), "id", F.lit(".md"))))


J25 = B.oracle("nodes") + """, q as (select case when p_partkey % 4 = 0 then 'components/p-' || p_partkey || '.md' when p_partkey % 2 = 0 then 'p-' || p_partkey else p_partkey::varchar end query, case when p_partkey % 2 = 0 then 'p-' || p_partkey else p_partkey::varchar end key from part),
 k as (select id, 0 r, id key from nodes union all select id, 1, id from nodes union all select id, 2, regexp_extract(id, '^(.+)-([0-9a-hjkmnp-tv-z]{6})$', 2) from nodes union all select id, 3, regexp_extract(id, '-([0-9]+)$', 1) from nodes),
 m as (select q.query, r, count(distinct id) n, min(id) id from q left join k using (key) group by 1, 2),
 b as (select *, row_number() over (partition by query order by r nulls first) rn from m)
select query, case when n = 1 then id end id, case n when 0 then 'none' when 1 then 'found' else 'ambiguous' end outcome from b where rn = 1
"""

N, NE = B.oracle("nodes"), B.oracle("nodes", "edges")
QUERIES = {
    "M1_validate": (m1, M1),
    "M2_repair": (m2, M2),
    "M3_add_edges": (m3, M3),
    "M4_remove_edges": (m4, M4),
    "M5_rename": (m5, M5),
    "M6_create_nodes": (m6, N + "select f.id, 'component' node_type, case when n.id is null then 'created' else 'exists' end outcome from (select case when p_partkey % 2 = 0 then 'p-' else 'x-' end || p_partkey id from part) f left join nodes n using (id)"),
    "M7_update_status": (m7, M7),
    "M8_update_nodes": (m8, N + ", c as (select 'o-' || o_orderkey id, case when o_orderkey % 3 = 0 then 'changed body' end b, case when o_orderkey % 5 = 0 then 'new owner' end o from orders) select id, coalesce(o, owner) as owner, sha256(coalesce(b, body)) content_hash from nodes left join c using (id)"),
    "M9_index_changes": (m9, M9),
    "M11_migrate": (m11, M11),
    "M17_delete_nodes": (m17, M17),
    "F2_nodes_of_type": (lambda s, d: P.nodes_of_type(nodes(s, d), "component").select("id", "title", "owner"), N + "select id, title, owner from nodes where node_type = 'component'"),
    "F3_edges_as_of": (lambda s, d: strings(G.temporal(edges(s, d), "as_of", F.lit(DAY).cast("date"))), B.oracle("edges") + f"select {E_SQL} from edges where {AS_OF}"),
    "F4_edges_current": (lambda s, d: strings(G.temporal(edges(s, d))).drop("valid_until"), B.oracle("edges") + "select source_id, edge_idx, target_id, edge_type, valid_from::varchar valid_from from edges where valid_until is null"),
    "F5_edges_history": (lambda s, d: G.temporal(edges(s, d), "history").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")), B.oracle("edges") + "select edge_type, count(*) n from edges group by 1"),
    "F6_visible_nodes": (lambda s, d: nodes(s, d).filter(G.visible()).select("id", "status"), N + "select id, status from nodes where coalesce(status, '') <> 'superseded'"),
    "F7_section_status": (lambda s, d: nodes(s, d).filter("status is null or status in ('active', 'draft')").select("id", "status"), N + "select id, status from nodes where status is null or status in ('active', 'draft')"),
    "F14_lookup": (lambda s, d: nodes(s, d).join(B.raw(s, d, "orders").select(F.concat(F.lit("o-"), "o_orderkey").alias("id")), "id", "left_semi").select("id", T.content_hash(F.col("body")).alias("content_hash"), "node_type"), N + "select id, sha256(body) content_hash, node_type from nodes where id in (select 'o-' || o_orderkey from orders)"),
    "J1_outgoing": (lambda s, d: G.outgoing(nodes(s, d), edges(s, d), "uses").select("source_id", "edge_idx", "target_id", "target_type", "target_title"), NE + "select source_id, edge_idx, target_id, node_type target_type, title target_title from edges join nodes on id = target_id where edge_type = 'uses'"),
    "J2_incoming": (lambda s, d: G.incoming(edges(s, d), nodes(s, d).filter("node_type = 'epic'")).select("source_id", "target_id", "edge_type"), NE + "select source_id, target_id, edge_type from edges where target_id in (select id from nodes where node_type = 'epic')"),
    "J3_dangling": (lambda s, d: G.dangling(nodes(s, d), edges(s, d)).select("source_id", "target_id", "edge_type"), NE + "select source_id, target_id, edge_type from edges where target_id not in (select id from nodes)"),
    "J4_disallowed": (lambda s, d: M.disallowed(nodes(s, d), edges(s, d), *schema(s)).groupBy("source_type", "edge_type", "target_type").agg(F.count(F.lit(1)).alias("n")), f"{FULL}, {TRIPLES} select source_type, edge_type, target_type, count(*) n from bad group by all"),
    "J5_missing_reverse": (lambda s, d: M.missing_reverse(nodes(s, d), edges(s, d), B.edge_types(s)).select("source_id", "target_id", "reverse"), f"{FULL}, known as materialized (select e.source_id, e.target_id, reverse from edges e join edge_types using (edge_type) join nodes n on n.id = e.target_id), there as materialized (select distinct target_id source_id, source_id target_id, edge_type reverse, 1 one from edges) select source_id, target_id, reverse from known left join there using (source_id, target_id, reverse) where one is null"),
    "J6_as_of_join": (j6, J6),
    "J25_resolve": (resolve, J25),
    "A1_type_counts": (lambda s, d: G.type_counts(nodes(s, d)), N + "select node_type, count(*) n from nodes group by 1"),
    "A2_graph_totals": (lambda s, d: G.graph_totals(nodes(s, d), edges(s, d)), NE + "select (select count(*) from nodes) n_nodes, (select count(distinct node_type) from nodes) n_types, (select count(*) from edges) n_edges, (select count(*) from (select distinct source_id, target_id, edge_type from edges)) n_distinct_edges"),
    "K2_listing": (lambda s, d: G.listing(nodes(s, d), 50, node_type="feature", status="active").select("id", F.date_format("updated", "yyyy-MM-dd").alias("updated")), N + "select id, strftime(updated, '%Y-%m-%d') updated from nodes where node_type = 'feature' and status = 'active' order by nodes.updated desc nulls last, id limit 50"),
    "V1_bfs": (lambda s, d: paths(G.bfs(roots(s, d), nodes(s, d), near(s, d), 2)), bfs_sql(2) + f"select {PATHS} from reached"),
    "V2_bfs_edge_types": (lambda s, d: paths(G.bfs(roots(s, d), nodes(s, d), near(s, d), 3, ("serves", "child_of", "uses"))), bfs_sql(3, ("serves", "child_of", "uses")) + f"select {PATHS} from reached"),
    "V3_bfs_scored": (lambda s, d: G.scored(G.bfs(roots(s, d), nodes(s, d), near(s, d), 2, paths=False)).select("root_id", "id", "score"), bfs_sql(2) + f"select root_id, id, {HOP}::double score from reached"),
    "V5_traverse_payload": (lambda s, d: G.with_payload(G.bfs(roots(s, d), nodes(s, d), near(s, d), 2, ("serves", "child_of"), paths=False), nodes(s, d)).select("root_id", "id", "depth", "node_type", "status", "title"), bfs_sql(2, ("serves", "child_of")) + "select root_id, id, depth, node_type, status, title from reached join nodes using (id)"),
    "V6_temporal_traverse": (lambda s, d: paths(G.bfs(roots(s, d), nodes(s, d), near(s, d, lambda e: G.temporal(e, "as_of", F.lit(DAY).cast("date"))), 2, ("serves", "uses", "child_of"))), bfs_sql(2, ("serves", "uses", "child_of"), AS_OF) + f"select {PATHS} from reached"),
}
