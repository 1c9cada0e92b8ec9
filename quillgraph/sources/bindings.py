"""Graph, journal and search views over the driver's tables.

The texts below are SQL that both Spark and the test oracle read; ``{orders}`` and the like
name tables, ``{ARR}`` the array constructor. A view's rows follow only from its tables, so
its work grows with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.schema import ALLOWED_EDGES, EDGE_TYPES, NODE_TYPES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations pages".split()

#: Clocks that keep recency stable.
JOURNAL_NOW = "2024-01-31 00:00:00"
NODES_NOW = "2001-08-02 00:00:00"

NODES = """
select 'o-' || o_orderkey id, 'feature' node_type,
  case when o_orderkey % 211 = 0 then null when o_orderkey % 223 = 0 then 'banana' when o_orderkey % 13 = 0 then 'superseded'
    when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then 'active' else 'draft' end status,
  case when o_orderkey % 199 = 0 then null else o_orderpriority end owner, o_orderdate updated,
  'Order ' || o_orderkey title, '# Order ' || o_orderkey || chr(10) || chr(10) || 'Placed by customer ' || o_custkey || '.' || chr(10) || '## Notes' || chr(10) || 'Priority ' || o_orderpriority body from {orders}
union all
select 'c-' || c_custkey, 'persona', 'active', c_mktsegment, null, c_name, '# ' || c_name || chr(10) || chr(10) || 'Buys ' || c_mktsegment from {customer}
union all
select 'p-' || p_partkey, 'component', 'active', p_brand, null, p_name, '# ' || p_name || chr(10) || chr(10) || 'A ' || p_type || ' by ' || p_brand from {part}
union all
select 's-' || s_suppkey, case when s_suppkey % 41 = 0 then 'vendor' else 'decision' end, case when s_suppkey % 2 = 0 then 'decided' else 'discussing' end, 'owner-' || s_nationkey, null, s_name, '# ' || s_name || chr(10) || 'needs: review' from {supplier}
union all
select 'n-' || n_nationkey, 'epic', 'active', 'owner-' || n_regionkey, null, n_name, '# ' || n_name from {nation}
union all
select 'r-' || r_regionkey, 'epic', 'active', 'owner', null, r_name, '# ' || r_name from {region}
"""

_FORWARD = """
select 'o-' || o_orderkey source_id, 'serves' edge_type, 'c-' || o_custkey target_id, cast(o_orderdate as date) valid_from, cast(null as date) valid_until, o_orderkey k from {orders}
union all
select 'o-' || l_orderkey, 'uses', 'p-' || l_partkey, cast(o_orderdate as date), case when l_returnflag = 'R' then cast(o_orderdate as date) + cast(90 * l_linenumber as int) end, l_orderkey
  from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber nulls first, l_returnflag nulls first) rn from {lineitem}) l join {orders} o on l_orderkey = o_orderkey where rn = 1
union all
select 'o-' || l_orderkey, 'depends_on', 's-' || l_suppkey, cast(o_orderdate as date), case when l_returnflag = 'R' then cast(o_orderdate as date) + cast(90 * l_linenumber as int) end, l_orderkey
  from (select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber nulls first, l_returnflag nulls first) rn from {lineitem}) l join {orders} o on l_orderkey = o_orderkey where rn = 1
union all
select 'c-' || c_custkey, 'child_of', 'n-' || c_nationkey, null, null, c_custkey from {customer}
union all
select 'n-' || n_nationkey, 'child_of', 'r-' || n_regionkey, null, null, n_nationkey + 1 from {nation}
"""

EDGES = f"""
select source_id, cast(row_number() over (partition by source_id order by edge_type, target_id) - 1 as int) edge_idx, target_id, edge_type, valid_from, valid_until from (
  select source_id, edge_type, target_id, valid_from, valid_until from ({_FORWARD}) f
  union all
  select target_id, case edge_type when 'serves' then 'served_by' when 'uses' then 'used_by' when 'depends_on' then 'dependency_of' else 'parent_of' end, source_id, valid_from, valid_until
    from ({_FORWARD}) b where k % 97 <> 0
  union all
  select 'o-' || o_orderkey, 'uses', 'p-missing-' || o_orderkey, cast(o_orderdate as date), null from {{orders}} where o_orderkey % 101 = 0
) e
"""

ENTRIES = """
select 'e-' || event_id id, ts, 'agent-' || (user_id % 7) agent, kind, event_type || ' on item ' || (k % 50) summary,
  case when kind in ('decision', 'dead_end') then 'Detail of ' || event_type || ' by user ' || user_id || ' with value band ' || (event_id % 10) || ', kept for the record.' else 'Short note ' || (event_id % 10) end detail,
  {ARR}('k' || (k % 5), event_type) tags, {ARR}('src/f' || (k % 20) || '.py', 'src/g' || (event_id % 3) || '.py') files, {ARR}('o-' || (event_id % 500 + 1)) refs,
  cast(user_id as varchar(20)) || '-' || cast(cast(ts as date) as varchar(10)) session_id, 'wt-' || (user_id % 11) worktree,
  case when event_id % 11 = 0 then null else 'sha' || (event_id % 97) end head, event_id % 6 = 0 provisional,
  row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) = 1 final
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) k,
  case event_type when 'error' then 'dead_end' when 'purchase' then 'decision' when 'signup' then 'plan' when 'view' then 'finding' else 'outcome' end kind from {events}) x
"""

DOCS = """
select cast(doc_id as varchar(20)) id, doc_id, text body, lang node_type, source owner,
  case when position(chr(10) in text) > 0 then substr(text, 1, position(chr(10) in text) - 1) else text end title from {documents}
"""

VECTORS = "select vec_id id, label node_type, embedding from {embeddings}"

VIEWS = {"nodes": NODES, "edges": EDGES, "entries": ENTRIES, "docs": DOCS, "vectors": VECTORS}


def edges(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows of ``EDGES`` whose source ``keep`` leaves in, which comes before they are numbered. Orders and lines are dealt by order once: both windows over an order's lines and the join
    with the order lie in that partition, and a line gives its edges in both directions there."""
    c, null = F.col, F.lit(None).cast("date")
    named = lambda prefix, key: F.concat(F.lit(prefix), c(key))
    edge = lambda df, source, kind, target, start=null, end=null: df.select(source.alias("source_id"), kind.alias("edge_type"), target.alias("target_id"), start.alias("valid_from"), end.alias("valid_until"))
    orders = raw(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), "o_custkey", c("o_orderdate").cast("date").alias("day"))
    first = lambda key: F.row_number().over(Window.partitionBy("l_orderkey", key).orderBy(F.asc_nulls_first("l_linenumber"), F.asc_nulls_first("l_returnflag"))) == 1
    lines = raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")
    lines = lines.withColumn("by_part", first("l_partkey")).withColumn("by_supplier", first("l_suppkey"))
    lines = lines.join(orders.select("k", "day"), c("l_orderkey") == c("k"))
    back = c("k") % 97 != 0
    # the place of an edge's type in the list below; without a row where the line gives no such edge
    places = F.array(F.when(c("by_part"), 0), F.when(c("by_part") & back, 1), F.when(c("by_supplier"), 2), F.when(c("by_supplier") & back, 3))
    lines = lines.select("*", F.explode(places).alias("i")).filter("i is not null")
    kind = F.when(c("i") == 0, "uses").when(c("i") == 1, "used_by").when(c("i") == 2, "depends_on").otherwise("dependency_of")
    item, order = F.when(c("i") < 2, named("p-", "l_partkey")).otherwise(named("s-", "l_suppkey")), named("o-", "k")
    forth = c("i").isin(0, 2)
    until = F.when(c("l_returnflag") == "R", F.date_add("day", (90 * c("l_linenumber")).cast("int")))
    parts = [edge(lines, F.when(forth, order).otherwise(item), kind, F.when(forth, item).otherwise(order), c("day"), until)]
    customers = raw(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), "c_nationkey")
    nations = raw(spark, sf_dir, "nation").select((c("n_nationkey") + 1).alias("k"), "n_nationkey", "n_regionkey")
    for df, source, forward, target, reverse, start in (
        (orders, order, "serves", named("c-", "o_custkey"), "served_by", c("day")),
        (customers, named("c-", "k"), "child_of", named("n-", "c_nationkey"), "parent_of", null),
        (nations, named("n-", "n_nationkey"), "child_of", named("r-", "n_regionkey"), "parent_of", null),
    ):
        parts += [edge(df, source, F.lit(forward), target, start), edge(df.filter(back), target, F.lit(reverse), source, start)]
    parts.append(edge(orders.filter("k % 101 = 0"), order, F.lit("uses"), named("p-missing-", "k"), c("day")))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last("edge_type"), F.asc_nulls_last("target_id")))
    return keep(reduce(DataFrame.unionByName, parts)).select("source_id", (place - 1).alias("edge_idx"), "target_id", "edge_type", "valid_from", "valid_until")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    if name == "edges":
        return edges(spark, sf_dir)
    text = VIEWS[name].replace("varchar(20)", "string").replace("varchar(10)", "string").replace("{ARR}", "array")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def node_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NODE_TYPES, "node_type string, directory string, required array<string>, statuses array<string>")


def allowed_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED_EDGES, "source_type string, edge_type string, target_type string")


def edge_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE_TYPES, "edge_type string, reverse string")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(*views: str) -> str:
    """The CTE prefix that defines ``views`` and the schema tables for the test oracle."""
    out = []
    for v in views:
        if v in VIEWS:
            text = VIEWS[v].replace("{ARR}", "list_value")
            for t in TABLES:
                text = text.replace("{" + t + "}", t)
            out.append(f"{v} as materialized ({text})")
    quote = lambda x: "null" if x is None else "[" + ", ".join(map(quote, x)) + "]" if isinstance(x, (list, tuple)) else f"'{x}'"
    rows = lambda table: ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in table)
    for name, table, cols in (("node_types", NODE_TYPES, "node_type, directory, required, statuses"), ("allowed_edges", ALLOWED_EDGES, "source_type, edge_type, target_type"), ("edge_types", EDGE_TYPES, "edge_type, reverse")):
        if name in views:
            out.append(f"{name} as (select * from (values {rows(table)}) t({cols}))")
    return "with recursive " + ",\n".join(out) + "\n"


def journal_now() -> object:
    return F.lit(JOURNAL_NOW).cast("timestamp")
