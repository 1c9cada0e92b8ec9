"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chat, corpus_queries, decontam, htmlpages, kdshard, license, mixing, pii, quality, simhash, urlfilter
from quillgraph.llm._spark import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in pii.BASE_KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the pages: their hosts' registered parts and every third page.

    The tables hold no list, so entries are derived: an MD5 of the value sets when it was
    added in 2024, its category, and whether it was removed and added again."""
    urls = pages.select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"), F.pmod("page_id", F.lit(3)).alias("m"))
    hosts = urls.select(F.when(F.size(F.split("h", r"\.")) > 3, F.regexp_replace("h", r"^[^.]+\.", "")).otherwise(F.col("h")).alias("value"))
    values = hosts.unionByName(urls.filter("m = 0 and p <> ''").select(F.concat("h", "p").alias("value"))).filter("value <> ''").distinct()
    number = lambda a: F.conv(F.substring(F.md5(F.col("value").cast("binary")), a, 3), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    kind = F.when(number(1) % 3 == 0, "spam").when(number(1) % 3 == 1, "adult").otherwise("malware")
    added, gone = number(4) % 200, number(4) % 200 + 1 + number(7) % 120
    return values.select("value", kind.alias("category"), F.explode(F.concat(
        F.array(F.struct(day(added).alias("at"), F.lit("add").alias("action"))),
        F.when(number(10) % 2 == 0, F.array(F.struct(day(gone).alias("at"), F.lit("remove").alias("action")))).otherwise(F.array().cast("array<struct<at:timestamp,action:string>>")),
        F.when(number(10) % 4 == 0, F.array(F.struct(day(gone + 40).alias("at"), F.lit("add").alias("action")))).otherwise(F.array().cast("array<struct<at:timestamp,action:string>>")),
    )).alias("e")).select("value", "category", "e.at", "e.action")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(366 * 24)) * 3600)
    found = urlfilter.judge(pages.select("page_id", "url", fetched.alias("fetched")), dated_list(pages))
    return found.select(F.col("id").alias("page_id"), "url", F.date_format("fetched", "yyyy-MM-dd HH:mm").alias("fetched"), "listed", "value", "category", F.date_format("since", "yyyy-MM-dd").alias("since"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        F.expr(decontam.CONTAMINATED).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.weigh(table(spark, sf_dir, "documents"), alpha=0.7)
    return drawn.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


#: The expected share of tokens that op7_mixing_budget keeps.
OP7_BUDGET = 0.85


def op7_mixing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.weigh(table(spark, sf_dir, "documents"), alpha=0.7, budget=OP7_BUDGET)
    return drawn.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(extra))).drop("n_tokens", "n_loss_tokens")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlpages.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_simhash": op2_simhash,
        "op3_url_filter": op3_url_filter,
        "op4_decontamination": op4_decontamination,
        "op5_sharding": op5_sharding,
        "op6_license_scan": op6_license_scan,
        "op7_mixing": op7_mixing,
        "op7_mixing_budget": op7_mixing_budget,
        "op8_chat_format": op8_chat_format,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_text": op10_html_text,
        **corpus_queries.QUERIES,
    }


OP4 = r"""
with d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (
  select distinct item_id, least(13, len(w)) l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0)),
ls as (select distinct l from bw),
dw as (
  select r, l, i, array_to_string(w[i:i + l - 1], ' ') k
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) i from d, ls where len(w) >= l)),
m as (select r, dw.l, i, item_id from dw join bw on dw.k = bw.k and dw.l = bw.l),
h as (select r, count(distinct p) n from (select r, unnest(range(i, i + l)) p from m) group by 1),
bp as (
  select item_id, j, len(w) n, least(13, len(w)) l, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') k
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) j from b where len(w) > 0)),
mp as (select distinct r, dw.l, i, item_id, n, j from dw join bp on dw.k = bp.k and dw.l = bp.l),
g as (select r, l, item_id, n, i - j diagonal, i - row_number() over (partition by r, item_id, n, l, i - j order by i) part from mp),
x as (select r, max(l + c - 1)::bigint longest from (select r, l, count(*) c from g group by r, l, item_id, n, diagonal, part) group by 1),
t as (select r, count(*) n, string_agg(item_id, ',' order by item_id) s from (select distinct r, item_id::varchar item_id from m) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items, sha256(coalesce(t.s, '')) items_sha256,
  coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) contaminated, coalesce(x.longest, 0)::bigint longest_match
from d left join h using (r) left join t using (r) left join x using (r)
"""


#: Iterations that the SQL twin unrolls; the weights stand still before that.
OP7_ITERATIONS = 24


def _op7(alpha: float = 0.7, iterations: int = OP7_ITERATIONS, budget: float | None = None) -> str:
    axes = mixing.AXES
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(set(ws))) + "]"
    scores = ", ".join(f"{{'n': len(list_intersect(w, {quoted(ws)})), 'k': {-k}, 't': '{name}'}}" for k, (name, ws) in enumerate(mixing.TOPICS.items()))
    sql = rf"""with d as (
  select doc_id, list_distinct(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) w, coalesce(source, '') source, coalesce(lang, '') lang,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint tokens from documents),
s as (select doc_id, source, lang, tokens, list_sort([{scores}], 'desc')[1] b from d),
r as (select doc_id, source, lang, tokens, case when b.n = 0 then '{mixing.GENERAL}' else b.t end topic from s),
c as (select source, lang, topic, sum(tokens)::double tokens from r group by all having sum(tokens) > 0),
"""
    for a in axes:
        sql += f"m_{a} as (select {a}, pow(sum(tokens), {alpha}) p from c group by all),\n"
    targets = ", ".join(f"(select p from m_{a} m where m.{a} = c.{a}) / (select sum(p) from m_{a}) * (select sum(tokens) from c) t_{a}" for a in axes)
    sql += f"w0 as materialized (select *, tokens weight, {targets} from c)"
    n = 0
    for _ in range(iterations):
        for a in axes:
            sql += f",\nw{n + 1} as materialized (select * replace (weight * t_{a} / sum(weight) over (partition by {a}) as weight) from w{n})"
            n += 1
    u = "('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496"
    p = f"weight / w.tokens / (select max(weight / tokens) from w{n})"
    if budget is not None:  # the first k cells of largest factor are kept whole, the others scaled to the rest of the budget
        sql += f""",
o as (select weight / tokens f, tokens, row_number() over (order by weight / tokens desc) k from w{n}),
q as (select k, f, coalesce(sum(tokens) over (order by k rows between unbounded preceding and 1 preceding), 0) whole, sum(tokens * f) over (order by k rows between current row and unbounded following) loose, sum(tokens) over () total from o),
z as (select coalesce(min_by(({budget} * total - whole) / loose, k), 1e300) scale from q where ({budget} * total - whole) / loose * f < 1)"""
        p = "least(1.0, weight / w.tokens * (select scale from z))"
    return sql + f"\nselect doc_id, source, lang, topic, r.tokens, round(coalesce({p}, 1.0), 6) probability, {u} < coalesce({p}, 1.0) kept from r left join w{n} w using (source, lang, topic)"


OP3 = r"""
with u as (select page_id, url,
  lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) h,
  regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*?)/?(?:[?#]|$)', 1) p,
  to_timestamp(1704067200 + (((page_id * 7919) % 8784 + 8784) % 8784) * 3600)::timestamp fetched from pages),
v as (
  select distinct value from (
    select case when len(string_split(h, '.')) > 3 then regexp_replace(h, '^[^.]+\.', '') else h end as value from u
    union all select h || p from u where page_id % 3 = 0 and p <> '') where value <> ''),
n as (select value, ('0x' || substr(md5(value), 1, 3))::int a, ('0x' || substr(md5(value), 4, 3))::int b, ('0x' || substr(md5(value), 7, 3))::int c, ('0x' || substr(md5(value), 10, 3))::int d from v),
e as (
  select value, b % 200 as day, 'add' as action, d, a from n
  union all select value, b % 200 + 1 + c % 120, 'remove', d, a from n where d % 2 = 0
  union all select value, b % 200 + 1 + c % 120 + 40, 'add', d, a from n where d % 4 = 0),
i as (
  select value, case a % 3 when 0 then 'spam' when 1 then 'adult' else 'malware' end category, action,
    timestamp '2024-01-01' + day * interval 1 day since, lead(timestamp '2024-01-01' + day * interval 1 day) over (partition by value order by day) until from e),
m as (
  select page_id, url, fetched, value, category, since,
    row_number() over (partition by page_id order by length(value) desc nulls last, value desc) k
  from u left join i on action = 'add' and fetched >= since and (until is null or fetched < until)
    and (u.h = value or ends_with(u.h, '.' || value) or (u.p <> '' and u.h || u.p = value)))
select page_id, url, strftime(fetched, '%Y-%m-%d %H:%M') fetched, value is not null listed, value, category, strftime(since, '%Y-%m-%d') since from m where k = 1
"""


_ESC = "replace(replace({}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
OP8 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
f as (
  select *, '<|turn|>' || replace({_ESC.format("role")}, chr(10), chr(92) || chr(10)) || chr(10) || {_ESC.format("text")} || '<|end|>' || chr(10) formatted from c),
g as (
  select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) t,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') l, sum(length(formatted))::bigint formatted_chars from f group by 1)
select conv_id, n_turns, sha256(t) turns_sha256, length(l)::bigint loss_chars, sha256(l) loss_sha256, formatted_chars from g
"""


def _op6() -> str:
    """Templates by name and number; lines, and windows that begin at a template's bigram, are unnested, then joined."""
    values = lambda ts, first: ", ".join(f"({k}, '{name}', '{' '.join(text.split()).replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(ts, first))
    rows = values(license.TEMPLATES, 0) + ", " + values(license.TEXTS, len(license.TEMPLATES))
    share = license.THRESHOLD / (2 - license.THRESHOLD)
    return rf"""
with t0 as (select * from (values {rows}) t(k, name, body)),
t1 as (select k, name, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: w <> '') w from t0),
t as (select k, name, len(w) - 1 l, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) g from t1),
tn as (select k, count(*) n from t group by 1),
l0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
l1 as (select row_number() over () r, doc_id, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> '') w from l0),
l2 as (select r, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from l1 where len(w) > 1),
l as (select r, doc_id, len(g) n, unnest(g) g from l2),
m as (
  select r, doc_id, name, 2.0::double * count(*) / (any_value(l.n) + any_value(tn.n)) dice
  from l join t using (g) join tn on tn.k = t.k where t.k < {len(license.TEMPLATES)} group by r, doc_id, t.k, name),
b as (select doc_id, name, dice, r from m where dice >= {license.THRESHOLD}),
d1 as (select row_number() over () d, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') w from documents),
d2 as (select d, w, unnest(range(1, len(w))) i from d1),
d3 as materialized (select d, i, w[i] || ' ' || w[i + 1] g from d2),
h as materialized (select d, i, k, l, g from d3 join t using (g)),
ok as (select d, k from h join tn using (k) group by d, k having count(distinct g) >= {share} * any_value(n) - 1e-9),
s as (select d, k, i, l from h join ok using (d, k)),
x as (select s.d, s.k, s.i, count(distinct h.g) c from s join h on h.d = s.d and h.k = s.k and h.i >= s.i and h.i < s.i + s.l group by 1, 2, 3),
y as (select s.d, s.k, s.i, count(distinct d3.g) c from s join d3 on d3.d = s.d and d3.i >= s.i and d3.i < s.i + s.l group by 1, 2, 3),
z as (select x.d, x.k, max(2.0::double * x.c / (tn.n + y.c)) dice from x join y using (d, k, i) join tn on tn.k = x.k group by 1, 2 having max(2.0::double * x.c / (tn.n + y.c)) >= {license.THRESHOLD}),
p as (select doc_id, name, dice from z join d1 using (d) join t0 using (k)),
u as (select doc_id, name, dice, r, 0 q from b union all select doc_id, name, dice, null, 1 from p)
select doc_id, max_by(name, (dice, name)) license, round(max(dice), 6) dice, count(distinct r)::bigint n_lines, coalesce(sum(q), 0)::bigint n_passages
from documents left join u using (doc_id) group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": OP3,
        "op4_decontamination": OP4,
        "op6_license_scan": _op6(),
        "op7_mixing": _op7(),
        "op7_mixing_budget": _op7(budget=OP7_BUDGET),
        "op8_chat_format": OP8,
        **corpus_queries.SQL,
    }
