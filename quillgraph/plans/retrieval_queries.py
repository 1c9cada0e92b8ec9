"""Registered search queries, each beside its SQL twin. Queries are every row whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import journal as J
from quillgraph.operators import postings as P
from quillgraph.operators import search as R
from quillgraph.operators.search import Retrieval
from quillgraph.plans import stem_sql
from quillgraph.plans.graph_queries import HOP, bfs_sql
from quillgraph.plans.lineage import checkpoint
from quillgraph.sources import bindings as B

S = SparkSession
C = F.col
#: The default weights, boosts and token budget of hybrid retrieval.
K4 = Retrieval()


#: What full-text search looks at: a document's language and source are its tags.
SEARCHED = ("id", "title", "body", "tags")
NODE_FIELDS, ENTRY_FIELDS = ("id", "title", "body"), ("summary", "detail")


def docs(s: S, d: str) -> DataFrame:
    return B.view(s, d, "docs").withColumn("id", C("doc_id")).withColumn("tags", F.concat_ws(" ", "node_type", "owner"))


def asked(s: S, d: str) -> DataFrame:
    return docs(s, d).filter("doc_id % 100 = 0").select(C("doc_id").alias("query_id"), T.tokens(C("title")).alias("terms"))


def title_terms(s: S, d: str) -> DataFrame:
    return P.terms(docs(s, d).filter("doc_id % 100 = 0"), "id", "title")


def words(s: S, d: str, k: int | None = 30) -> DataFrame:
    return P.search(P.build(docs(s, d), *SEARCHED), title_terms(s, d), k)


def filtered_words(s: S, d: str) -> DataFrame:
    """K1 under a metadata filter: hits of one language, N and document frequencies of all."""
    return P.search(P.build(docs(s, d), *SEARCHED), title_terms(s, d), 30, allowed=docs(s, d).filter("node_type = 'de'"))


def vector_hits(s: S, d: str, k: int = 30) -> DataFrame:
    v = B.view(s, d, "vectors")
    return R.nearest(v, v.filter("id % 100 = 0").select(C("id").alias("query_id"), "embedding"), k)


def graph_roots(s: S, d: str) -> DataFrame:
    """The roots of hybrid retrieval: every order whose key is divisible by 100, with its number."""
    o = B.raw(s, d, "orders").filter("o_orderkey % 100 = 0")
    return o.select(F.concat(F.lit("o-"), "o_orderkey").alias("root_id"), C("o_orderkey").alias("k"))


def graph_asked(s: S, d: str) -> DataFrame:
    """A root asks for the name of a part, of which there are as many as there are parts."""
    p = B.raw(s, d, "part").select("p_partkey", "p_name")
    n = F.lit(p.count())
    return graph_roots(s, d).withColumn("p_partkey", C("k") % n + 1).join(p, "p_partkey").select(C("root_id").alias("query_id"), "p_name")


def part_vectors(s: S, d: str) -> DataFrame:
    return B.view(s, d, "vectors").select(F.concat(F.lit("p-"), C("id") + 1).alias("id"), C("id").alias("vec"), "embedding")


def graph_vector_hits(s: S, d: str) -> DataFrame:
    """Roots that ask by the same vector are one query."""
    v = part_vectors(s, d)
    roots = graph_roots(s, d).select(C("root_id").alias("query_id"), (C("k") % F.lit(v.count())).alias("content"))
    return R.nearest_uses(v.select(C("vec").alias("content"), "embedding"), v.select("id", C("vec").alias("content")), roots, 30)


def k4(s: S, d: str, with_vectors: bool) -> DataFrame:
    """K4: structural hop scores of the nodes within two hops of each root, the 30 best by words, the 30 nearest by vector."""
    n, now = B.view(s, d, "nodes"), F.lit(B.NODES_NOW).cast("timestamp")
    payload = n.select("id", "node_type", "updated", T.node_tokens(C("title"), C("body")).alias("tokens"))
    carried = payload.select("id", R.boosts(now, K4).alias("boost"), "tokens")
    hops = G.scored(G.distances(graph_roots(s, d), carried, B.view(s, d, "edges"), 2, ("boost", "tokens"))).select(C("root_id").alias("query_id"), "id", "score", "boost", "tokens")
    words_ = P.search(P.build(n, *NODE_FIELDS), P.terms(graph_asked(s, d), "query_id", "p_name"), 30)
    near = graph_vector_hits(s, d).select("query_id", "id", C("similarity").alias("score")) if with_vectors else None
    out = R.hybrid(hops, words_, near, payload, now, K4)
    return out.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def journal(s: S, d: str) -> DataFrame:
    return B.view(s, d, "entries").withColumn("id", F.substring("id", 3, 20).cast("long"))


def journal_words(s: S, d: str) -> DataFrame:
    e = journal(s, d)
    return P.search(P.build(e, *ENTRY_FIELDS), P.terms(e.filter("id % 100 = 0"), "id", "summary"), 40, every=True)


def journal_vectors(s: S, d: str) -> DataFrame:
    """One vector serves many entries (J8): an entry's content key is its id within the vectors."""
    v = B.view(s, d, "vectors").select(C("id").alias("content"), "embedding")
    e = journal(s, d).select("id", (C("id") % F.lit(v.count())).alias("content"))
    return R.nearest_uses(v, e, e.filter("id % 100 = 0").select(C("id").alias("query_id"), "content"), 40)


def k7(s: S, d: str) -> DataFrame:
    fused = R.fuse_ranks(journal_words(s, d), journal_vectors(s, d)).join(journal(s, d), "id")
    out = J.boosted(fused, B.journal_now())
    return out.select("query_id", "id", "word_rank", "vector_rank", F.round(R.finite(C("rrf") + C("score")), 6).alias("score"))


def k6_combined(s: S, d: str) -> DataFrame:
    """K6: entries of the asking entry's type on its item or the next one, but none of band 3. Queries of the same terms are one
    class, answered once; what its documents add up to goes to each of them."""
    e = journal(s, d)
    t = T.tokens(C("summary"))
    item = F.element_at(t, -1)
    q = e.filter("id % 100 = 0").select(C("id").alias("query_id"), F.slice(t, 1, 1).alias("must"), F.array(item, (item.cast("int") + 1).cast("string")).alias("should"), F.array(F.lit("3")).alias("never"))
    asks = ["must", "should", "never"]
    q = checkpoint(q.withColumn("key", F.to_json(F.struct(*asks))))
    classes = q.groupBy("key", *asks).agg(F.min("query_id").alias("q"))
    found = R.combined(R.corpus(e, "summary", "detail"), classes.select(C("q").alias("query_id"), *asks))
    each = found.groupBy(C("query_id").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return q.select("query_id", "key").join(classes.select("key", "q"), "key").join(each, "q").select("query_id", "n", "first_id")


K6_COMBINED_TAIL = """, cw as materialized (select id, list_distinct({0}) w, {1} s from ex),
 cq as (select id query_id, s[1] m, s[-1] a, (s[-1]::int + 1)::varchar b from cw where id % 100 = 0)
select query_id, count(*) n, min(id) first_id from cq join cw on list_contains(w, m) and (list_contains(w, a) or list_contains(w, b)) and not list_contains(w, '3') group by 1"""


def w4(s: S, d: str) -> DataFrame:
    hits = journal_words(s, d).join(journal(s, d).select("id", "summary", "detail"), "id")
    return R.skip_budget(hits, 60).select("query_id", "rank", "id", F.length("detail").alias("n_detail"))


def k10(s: S, d: str) -> DataFrame:
    """The default scorer: the share of the query's distinct terms in the document's title."""
    hits = words(s, d, 60).join(asked(s, d), "query_id").join(docs(s, d).select("id", T.tokens(C("title")).alias("own")), "id")
    share = F.size(F.array_intersect("terms", "own")) / F.size(F.array_distinct("terms"))
    return R.rerank(hits, share).select("query_id", "id", "rank", "new_rank", "reranked")


TOK = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


#: The words of full-text search, before their terms are looked up.
WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: t <> '')"


def bm25_sql(source: str, text: str, query: str, k: int, every: bool = False, name: str = "hits", queries: str = "", where: str = "") -> str:
    """CTEs that end in ``name`` (query_id, id, score, rank); every posting is scored."""
    queries = queries or f"(select * from {source} where id % 100 = 0)"
    need = " having count(*) = any_value(q.needed)" if every else ""
    return f""", cx as materialized (select id, {WORDS.format(text)} w from {source}),
 qx as materialized (select id query_id, {WORDS.format(query)} w from {queries}),
 raw as (select distinct t from (select unnest(w) t from cx union all select unnest(w) from qx)),
 {stem_sql.stems("raw", "voc")},
 ca as materialized (select id, voc.w term, count(*) tf from (select id, unnest(w) t from cx) join voc using (t) group by 1, 2),
 cl as materialized (select id, sum(tf) l from ca group by 1),
 cn as (select (select count(*) from cx)::double n, (select sum(tf) from ca)::double / (select count(*) from cx) m),
 q as materialized (select query_id, term, count(*) over (partition by query_id) needed from (select distinct query_id, voc.w term from (select query_id, unnest(w) t from qx) join voc using (t))),
 df as (select term, count(*) df from ca group by 1),
 sc as (select query_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))) score
   from q join ca using (term) join cl using (id) join df using (term), cn {where} group by query_id, id{need}),
 {name} as materialized (select *, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int rank from sc qualify rank <= {k})"""


def budget_sql(source: str, budget: int, name: str = "fit") -> str:
    """CTEs from ``source`` (g, id, summary, detail, place) to ``name`` (g, id, place, detail): each group's rows one after the
    other, by place; a row whose summary does not fit is left out, the detail that does not is cut and uses up the budget."""
    return f""", so as materialized (select *, row_number() over (partition by g order by place) i from {source}),
 sf as (
  select g, 0::bigint i, {budget}::bigint room, null::varchar id, null::bigint place, null::varchar detail, false kept from so where i = 1
  union all
  select g, i, case when cost > room then room when need <= room - cost then room - cost - need else 0 end, id, place,
    case when need <= room - cost then detail when room - cost - 1 <= 0 then null when length(detail) > (room - cost - 1) * 4 then left(detail, (room - cost - 1) * 4) || '…' else detail end, cost <= room
  from (select so.g, so.i, sf.room, so.id::varchar id, so.place, so.detail, length(summary) // 4 + 1 as cost, case when so.detail is null then 0 else length(so.detail) // 4 + 1 end need from sf join so on so.g = sf.g and so.i = sf.i + 1)),
 {name} as materialized (select g, id, place, detail from sf where kept)"""


def knn_sql(source: str, k: int, name: str = "near") -> str:
    return f""", vn as materialized (select id, embedding e from {source}),
 vp as (select a.id query_id, b.id, list_cosine_similarity(a.e::double[], b.e::double[]) similarity from vn a, vn b where a.id % 100 = 0),
 {name} as materialized (select *, (row_number() over (partition by query_id order by round(similarity, 9) desc, id))::int rank from vp qualify rank <= {k})"""


DOCS = B.oracle("docs") + ", dx as materialized (select doc_id id, title, body, node_type, owner from docs)"
DTEXT = "concat_ws(' ', id, title, body, node_type, owner)"
DWORDS = DOCS + bm25_sql("dx", DTEXT, "title", 30)
VEC = B.oracle("vectors")


def k4_sql(with_vectors: bool) -> str:
    ws, ww, wv = (0.5, 0.25, 0.25) if with_vectors else (0.625, 0.375, 0.0)
    v = "union all select query_id, id, 'v', greatest(similarity, 0) from near" if with_vectors else ""
    near = """, vt as materialized (select vec_id vec, 'p-' || (vec_id + 1) id, embedding::double[] e from embeddings),
 vq as (select root_id query_id, e from rq join vt on vec = k % (select count(*) from embeddings)),
 vp as (select query_id, id, list_cosine_similarity(vq.e, vt.e) similarity from vq, vt),
 near as materialized (select * from vp qualify row_number() over (partition by query_id order by round(similarity, 9) desc, id) <= 30)""" if with_vectors else ""
    words_ = bm25_sql("nx", "concat_ws(' ', id, title, body)", "p_name", 30, queries="(select root_id id, p_name from rq join part on p_partkey = k % (select count(*) from part) + 1)")
    return bfs_sql(2) + ", nx as materialized (select * from nodes), rq as (select 'o-' || o_orderkey root_id, o_orderkey k from orders where o_orderkey % 100 = 0)" + words_ + near + f""",
 sw as (select query_id, id, case when max(score) over p - min(score) over p < 1e-12 then 1.0 else (score - min(score) over p) / (max(score) over p - min(score) over p) end score from hits window p as (partition by query_id)),
 al as (select root_id query_id, id, 's' side, ({HOP})::double score from reached union all select query_id, id, 'w', score from sw {v}),
 fu as (select query_id, id, max(score) filter (side = 's') s, max(score) filter (side = 'w') w, max(score) filter (side = 'v') v from al group by 1, 2),
 sc2 as (select query_id, id, coalesce(s, 0) * {ws} + coalesce(w, 0) * {ww} + coalesce(v, 0) * {wv} + case when epoch(timestamp '{B.NODES_NOW}') - epoch(updated) < 8 * 86400 then 0.1 else 0 end + case when node_type in ('decision', 'constraint') then 0.05 else 0 end score, (strlen(title) + strlen(body)) // 4 tokens
   from fu join nx using (id)),
 rk as (select *, (row_number() over o)::int rank, sum(tokens) over (partition by query_id order by round(score, 9) desc, id rows unbounded preceding) cum from sc2 window o as (partition by query_id order by round(score, 9) desc, id))
select query_id, id, rank, round(score, 6) score from rk where rank = 1 or cum <= 8000"""


ENT = B.oracle("entries") + ", ex as materialized (select substr(id, 3)::bigint id, ts, kind, summary, detail from entries)"
JW = ENT + bm25_sql("ex", "concat_ws(' ', summary, detail)", "summary", 40, every=True)
REC = f"case when ts >= timestamp '{B.JOURNAL_NOW}' then 0.5 else 0.5 * pow(2.0, -(epoch(timestamp '{B.JOURNAL_NOW}') - floor(epoch(ts))) / 86400.0 / 14.0) end"
BOOST = "case kind when 'decision' then 0.5 when 'dead_end' then 0.5 when 'finding' then 0.3 when 'outcome' then 0.2 else 0.0 end"
K7 = JW + ", ve as (select id, embedding from ex join embeddings on vec_id = ex.id % (select count(*) from embeddings))" + knn_sql("ve", 40) + f""",
 fu as (select coalesce(a.query_id, b.query_id) query_id, coalesce(a.id, b.id) id, a.rank word_rank, b.rank vector_rank from hits a full join near b on a.query_id = b.query_id and a.id = b.id)
select query_id, id, word_rank, vector_rank, round(coalesce(30.0::double / (60 + word_rank), 0) + coalesce(30.0::double / (60 + vector_rank), 0) + {REC} + {BOOST}, 6) score from fu join ex using (id)"""
CLASSES = ", c as (select node_type, lower(title) k, min(id) rep, count(*) n from docs group by 1, 2)"

#: Edits between two titles in characters, exact up to 2: DuckDB's levenshtein counts bytes, so it only rules pairs out (an edit
#: changes 4 bytes at most) and answers for ASCII. A row of the table of distances follows from the row before.
NEAR = """, v as (select *, list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i, 1))) u from c),
 p as materialized (select a.rep a, b.rep b, a.n n_a, b.n n_b, a.u ua, b.u ub, strlen(a.k) = length(a.k) and strlen(b.k) = length(b.k) plain, levenshtein(a.k, b.k)::int bytes
   from v a join v b on a.node_type = b.node_type and a.rep < b.rep where abs(length(a.k) - length(b.k)) <= 2 and levenshtein(a.k, b.k) <= 8),
 d as (select a, b, n_a, n_b, case when plain then bytes else list_reduce(list_transform(ua, lambda x: [x::int]), lambda o, x:
     list_transform([list_transform(range(1, len(o) + 1), lambda j: case when j = 1 then o[1] + 1 else least(o[j] + 1, o[j - 1] + (x[1] <> ub[j - 1])::int) end)],
       lambda t: list_transform(range(1, len(t) + 1), lambda j: (case j when 1 then t[1] when 2 then least(t[2], t[1] + 1) else least(t[j], t[j - 1] + 1, t[j - 2] + 2) end)::int))[1],
     range(0, len(ub) + 1)::int[])[-1] end distance from p)
select a, b, n_a, n_b, distance from d where distance <= 2"""

K10 = DOCS + bm25_sql("dx", DTEXT, "title", 60) + f""",
 ow as (select id, list_distinct({TOK.format("title")}) w from dx),
 sh as (select query_id, h.id, rank, len(list_intersect(a.w, b.w)) / len(a.w)::double s from hits h join ow a on a.id = query_id join ow b on b.id = h.id)
select query_id, id, rank, (row_number() over (partition by query_id order by rank > 50, case when rank > 50 then 0.0 else s end desc, rank))::int new_rank, rank <= 50 reranked from sh"""

QUERIES = {
    "A12_corpus_stats": (lambda s, d: R.corpus(docs(s, d), "title", "body").select("id", "n_terms", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n_terms").cast("long").alias("n_terms")), DOCS + f", x as (select id, {TOK.format(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', title, body)')} w from dx) select term, count(*) df, sum(n)::bigint n_terms from (select len(w) n, unnest(list_distinct(w)) term from x) group by 1"),
    "K1_keyword_search": (lambda s, d: words(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score")), DWORDS + " select query_id, id, rank, round(score, 6) score from hits"),
    "K1_filtered_search": (lambda s, d: filtered_words(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score")), DOCS + bm25_sql("dx", DTEXT, "title", 30, where="where id in (select id from dx where node_type = 'de')") + " select query_id, id, rank, round(score, 6) score from hits"),
    "K3_vector_search": (lambda s, d: vector_hits(s, d, 10).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity")), VEC + knn_sql("vectors", 10) + " select query_id, id, rank, round(similarity, 6) similarity from near"),
    "K4_hybrid": (lambda s, d: k4(s, d, True), k4_sql(True)),
    "K4_hybrid_without_vectors": (lambda s, d: k4(s, d, False), k4_sql(False)),
    "K6_journal_keyword": (lambda s, d: journal_words(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score")), JW + " select query_id, id, rank, round(score, 6) score from hits"),
    "K6_combined": (k6_combined, ENT + K6_COMBINED_TAIL.format(TOK.format("concat_ws(' ', summary, detail)"), TOK.format("summary"))),
    "K7_journal_hybrid": (k7, K7),
    "K10_rerank": (k10, K10),
    "W4_skip_budget": (w4, JW + ", sr as (select query_id g, id, rank place, summary, detail from hits join ex using (id))" + budget_sql("sr", 60) + " select g query_id, place::int rank, id::varchar id, length(detail)::int n_detail from fit"),
    "K17_similar_titles": (lambda s, d: R.similar_titles(B.view(s, d, "docs")), B.oracle("docs") + CLASSES + ", w as (select node_type, rep, n, list_filter(regexp_split_to_array(k, '\\s+'), lambda x: x <> '') w from c), p as (select a.rep a, b.rep b, a.n n_a, b.n n_b, len(list_filter(a.w, lambda x: list_contains(b.w, x))) / greatest(len(a.w), len(b.w))::double s from w a join w b on a.node_type = b.node_type and a.rep < b.rep where len(a.w) > 0 and len(b.w) > 0 and len(a.w) >= 0.8 * len(b.w)) select a, b, n_a, n_b, round(s, 6) similarity from p where round(s, 6) >= 0.8"),
    "K18_near_titles": (lambda s, d: R.near_titles(B.view(s, d, "docs")), B.oracle("docs") + CLASSES + NEAR),
}
