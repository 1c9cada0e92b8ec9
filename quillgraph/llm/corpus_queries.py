"""The registered queries of operators 11 to 13, with the SQL twins of 11 and 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import centroids, collocations, winnowing
from quillgraph.llm._spark import UPPER, table


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Counts all phrases of one to four words, joins the parts of every cut, and looks for longer phrases of any length.
OP11 = rf"""
with p as (
  select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w from (
    select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) p from documents)),
g as materialized (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f
  from (select *, unnest(range(1, len(w) - k + 2)) i from (select lang, w, unnest(range(1, least(4, len(w)) + 1)) k from p)) group by all),
n as (select lang, sum(f)::bigint n from g where k = 1 group by 1),
c as materialized (select *, string_split(phrase, ' ') w from g where k > 1 and f >= 30),
q as materialized (select lang, phrase, f, j, array_to_string(w[1:j], ' ') p, array_to_string(w[j + 1:], ' ') q from (select *, unnest(range(1, k)) j from c)),
s as (
  select q.lang, q.phrase, q.f a, j, l.f l, r.f r, ((2000000::hugeint * q.f) // (l.f::hugeint + r.f))::bigint score
  from q join g l on l.lang = q.lang and l.phrase = q.p join g r on r.lang = q.lang and r.phrase = q.q),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as materialized (select lang, array_to_string(w[i:i + m - 1], ' ') phrase, f from (select *, unnest(range(1, k - m + 2)) i from (select lang, k, w, f, unnest(range(2, k)) m from c))),
x as (select lang, phrase, max(f) f from o group by 1, 2),
z as (select b.* from b left join x using (lang, phrase) where x.f is null or 100::hugeint * x.f < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score from z join n using (lang) qualify rank <= 2000
"""


def _op12(k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> str:
    sql = f"""
with v as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (select row_number() over (order by h, v) - 1 j, v c from (select sha256('{seed}:' || coalesce(vec_id::varchar, '')) h, v from v order by h, v limit {k}))"""
    for n in range(rounds + 1):
        sql += f""",
a{n} as materialized (select r, min(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint * {k} + j) b from v, c{n} group by r)"""
        if n < rounds:
            sql += f""",
u{n} as (select j, list((t - ((t % n) + n) % n) // n order by i) c from (select b % {k} j, i, sum(v[i]) t, count(*) n from a{n} join v using (r), range(1, {dims + 1}) d(i) group by 1, 2) group by 1),
c{n + 1} as materialized (select j, coalesce(u{n}.c, c{n}.c)::bigint[] c from c{n} left join u{n} using (j))"""
    return sql + f"""
select vec_id, j::int "cluster", b // {k} distance, (sum(b // {k}) over (partition by j))::bigint cluster_inertia, (sum(b // {k}) over ())::bigint inertia, sha256(array_to_string(c, ',')) centroid_sha256
from a{rounds} join v using (r) join c{rounds} on j = b % {k}
"""


QUERIES = {"op11_collocations": op11_collocations, "op12_centroids": op12_centroids, "op13_fingerprints": op13_fingerprints}
SQL = {"op11_collocations": OP11, "op12_centroids": _op12()}
