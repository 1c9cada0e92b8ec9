"""Validation, repair and changes of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.ranks import numbered
from quillgraph.plans.lineage import checkpoint


def _typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' types; only those whose ends both exist."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_type"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"))
    return edges.join(s, "source_id").join(t, "target_id")


def permitted(node_types: DataFrame, allowed: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Concrete (source_type, edge_type, target_type) triples: wildcards spelt out, and the
    reverse of each allowed triple, which the schema allows without saying so."""
    every = node_types.agg(F.collect_set("node_type").alias("all"))
    any_of = lambda c: F.explode(F.when(F.col(c) == "*", F.col("all")).otherwise(F.array(c)))
    flat = allowed.join(F.broadcast(every), F.lit(True)).select(any_of("source_type").alias("source_type"), "edge_type", "target_type", "all").select("source_type", "edge_type", any_of("target_type").alias("target_type"))
    back = flat.join(edge_types, "edge_type").select(F.col("target_type").alias("source_type"), F.col("reverse").alias("edge_type"), F.col("source_type").alias("target_type"))
    return flat.unionByName(back).distinct()


def disallowed(nodes: DataFrame, edges: DataFrame, node_types: DataFrame, allowed: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Edges between existing nodes that no triple allows (unknown types allow none)."""
    return _typed(edges, nodes).join(permitted(node_types, allowed, edge_types), ["source_type", "edge_type", "target_type"], "left_anti")


def missing_reverse(nodes: DataFrame, edges: DataFrame, edge_types: DataFrame) -> DataFrame:
    """Edges of a known type between existing nodes without (target, reverse, source): (source_id, edge_type, target_id, reverse).

    Edges of a pair of nodes, in both directions, are dealt together once and reduced to their kinds with a count, of
    which there are at most as many as types; only edges that lack their reverse meet the nodes."""
    flip = F.coalesce(F.col("target_id") < F.col("source_id"), F.lit(False))
    end = lambda a, b: F.when(flip, F.col(a)).otherwise(F.col(b))
    kinds = edges.select(end("target_id", "source_id").alias("lo"), end("source_id", "target_id").alias("hi"), flip.alias("back"), "edge_type")
    kinds = kinds.repartition("lo", "hi").groupBy("lo", "hi", "back", "edge_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    kinds = kinds.join(F.broadcast(edge_types.select("edge_type", "reverse")), "edge_type", "left")
    pairs = kinds.groupBy("lo", "hi").agg(F.collect_list(F.struct("back", "edge_type", "reverse", "n")).alias("kinds"))
    loop = F.col("lo") == F.col("hi")  # a loop's reverse lies in the same direction
    there = lambda x: F.exists("kinds", lambda y: (y["edge_type"] == x["reverse"]) & ((y["back"] != x["back"]) | loop))
    lacking = F.filter("kinds", lambda x: x["reverse"].isNotNull() & ~F.coalesce(there(x), F.lit(False)))
    rows = pairs.select("lo", "hi", F.explode(lacking).alias("k")).select("lo", "hi", "k.*").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i"))
    side = lambda a, b: F.when(F.col("back"), F.col(a)).otherwise(F.col(b))
    rows = rows.select(side("hi", "lo").alias("source_id"), "edge_type", side("lo", "hi").alias("target_id"), "reverse")
    return rows.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


#: What stands for a node's type where it has none: no such node, and several nodes of one id, whose types are looked up.
GONE, SEVERAL = -2, -1


def _edge_issues(nodes: DataFrame, edges: DataFrame, triples: DataFrame, edge_types: DataFrame) -> DataFrame:
    """(kind, severity, node_id, detail) of edges without target, of edges that no triple allows and of edges without their reverse.

    An edge meets its target once, for the number of its type among those of ``triples`` (0: none). Then edges of a pair of nodes, in both
    directions, are dealt together and reduced to their kinds with a count. There an edge's source has the type that edges of the other
    direction have met; only pairs without one, or with several nodes of one id, meet the nodes again."""
    names = triples.select(F.col("source_type").alias("node_type")).union(triples.select("target_type")).distinct()
    names = F.broadcast(names.withColumn("t", F.row_number().over(Window.orderBy("node_type"))))  # as few as the schema has types
    typed = nodes.select("id", "node_type").join(names, "node_type", "left").groupBy("id").agg(F.when(F.count(F.lit(1)) > 1, SEVERAL).otherwise(F.coalesce(F.max("t"), F.lit(0))).alias("t"))
    met = edges.select("source_id", "edge_type", "target_id").join(typed.withColumnRenamed("id", "target_id"), "target_id", "left")
    flip = F.coalesce(F.col("target_id") < F.col("source_id"), F.lit(False))
    end = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
    kinds = met.select(end("target_id", "source_id").alias("lo"), end("source_id", "target_id").alias("hi"), flip.alias("back"), "edge_type", F.coalesce("t", F.lit(GONE)).alias("t")).repartition("lo", "hi")
    kinds = kinds.groupBy("lo", "hi", "back", "edge_type").agg(F.max("t").alias("t"), F.count(F.lit(1)).cast("int").alias("n"))
    kinds = kinds.join(F.broadcast(edge_types.select("edge_type", "reverse")), "edge_type", "left")
    type_of = lambda back: F.max(F.when(F.col("back") == back, F.col("t")))
    pairs = kinds.groupBy("lo", "hi").agg(F.collect_list(F.struct("back", "edge_type", "reverse", "n")).alias("kinds"), type_of(True).alias("t_lo"), type_of(False).alias("t_hi"))
    loop = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    pairs = pairs.withColumn("t_lo", F.when(loop, F.col("t_hi")).otherwise(F.col("t_lo")))
    side = lambda x, y: F.when(F.col("back"), F.col(x)).otherwise(F.col(y))
    ends = [side("hi", "lo").alias("source_id"), "edge_type", side("lo", "hi").alias("target_id"), "n"]
    there = lambda x: F.exists("kinds", lambda y: (y["edge_type"] == x["reverse"]) & ((y["back"] != x["back"]) | loop))
    judged = F.transform("kinds", lambda x: F.struct(x["back"], x["edge_type"], x["n"], (x["reverse"].isNotNull() & ~F.coalesce(there(x), F.lit(False))).alias("lacking")))
    each = pairs.select("lo", "hi", "t_lo", "t_hi", F.inline(judged).alias("back", "edge_type", "n", "lacking")).select(*ends, "lacking", side("t_hi", "t_lo").alias("s"), side("t_lo", "t_hi").alias("t"))
    number = lambda c: names.select(F.col("node_type").alias(f"{c}_type"), F.col("t").alias(c))
    allowed = triples.join(number("s").withColumnRenamed("s_type", "source_type"), "source_type").join(number("t").withColumnRenamed("t_type", "target_type"), "target_type")
    each = each.join(F.broadcast(allowed.select("s", "edge_type", "t", F.lit(True).alias("ok"))), ["s", "edge_type", "t"], "left")
    found = F.array(
        F.when(F.col("t") == GONE, "dangling_edge"),
        F.when((F.col("t") != GONE) & F.col("lacking"), "missing_reverse"),
        F.when((F.col("s") >= 0) & (F.col("t") >= 0) & F.col("ok").isNull(), "disallowed_edge"),
    )
    each = each.select("source_id", "edge_type", "target_id", "n", F.explode(F.array_compact(found)).alias("kind"))
    open_ = pairs.filter((F.col("t_lo").isNull() | F.col("t_hi").isNull() | (F.col("t_lo") == SEVERAL) | (F.col("t_hi") == SEVERAL))).select("lo", "hi", F.inline(F.transform("kinds", lambda x: F.struct(x["back"], x["edge_type"], x["n"]))).alias("back", "edge_type", "n")).select(*ends)
    bad = _typed(open_, nodes).join(F.broadcast(triples), ["source_type", "edge_type", "target_type"], "left_anti").withColumn("kind", F.lit("disallowed_edge"))
    issues = each.unionByName(bad.select(each.columns))
    severity = F.when(F.col("kind") == "missing_reverse", "warning").otherwise("error")
    issues = issues.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_i"))
    return issues.select("kind", severity.alias("severity"), F.col("source_id").alias("node_id"), F.concat(F.col("edge_type"), F.lit(" -> "), F.col("target_id")).alias("detail"))


def validate(nodes: DataFrame, edges: DataFrame, node_types: DataFrame, allowed: DataFrame, edge_types: DataFrame) -> DataFrame:
    """M1: (kind, severity, node_id, detail): unknown type, missing status or owner, status not
    allowed, dangling edge, edge not allowed, missing reverse edge."""
    typed = nodes.join(node_types, "node_type")
    issue = lambda df, kind, node, detail: df.select(F.lit(kind).alias("kind"), F.lit("error").alias("severity"), F.col(node).alias("node_id"), detail.alias("detail"))
    absent = F.explode(F.array_compact(F.array(*[F.when(F.array_contains("required", c) & F.col(c).isNull(), F.lit(c)) for c in ("status", "owner")])))
    parts = [
        issue(nodes.join(node_types, "node_type", "left_anti"), "unknown_type", "id", F.col("node_type")),
        issue(typed.withColumn("f", absent), "missing_field", "id", F.col("f")),
        issue(typed.filter("status is not null and size(statuses) > 0 and not array_contains(statuses, status)"), "bad_status", "id", F.col("status")),
        _edge_issues(nodes, edges, permitted(node_types, allowed, edge_types), edge_types),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def renumber(edges: DataFrame) -> DataFrame:
    """Each source's edges sorted by target (ties by type) and numbered from 0; a hub's in ranges, not in one window."""
    order = [F.asc("target_id"), F.asc("edge_type"), F.col("valid_from").asc_nulls_first()]
    return numbered(edges, ["source_id"], order, "_at").withColumn("edge_idx", (F.col("_at") - 1).cast("int")).drop("_at")


def repair(nodes: DataFrame, edges: DataFrame, edge_types: DataFrame) -> DataFrame:
    """The edges with one added for each missing reverse, renumbered. Both are written out, for they are read again."""
    edges = checkpoint(edges)
    add = missing_reverse(nodes, edges, edge_types).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("reverse").alias("edge_type")).distinct()
    add = add.withColumns({"edge_idx": F.lit(0), "valid_from": F.lit(None).cast("date"), "valid_until": F.lit(None).cast("date")})
    return renumber(edges.unionByName(checkpoint(add.select(edges.columns))))


KEY = ["source_id", "edge_type", "target_id"]


def add_edges(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, edge_types: DataFrame, triples: DataFrame) -> DataFrame:
    """M3: requested edges (source_id, edge_type, target_id) with the outcome of each:
    'added', or the first reason against it. Added edges go in with their reverses."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_type"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"))
    there = edges.select(*KEY).distinct().withColumn("there", F.lit(True))
    ok = triples.withColumn("ok", F.lit(True))
    joined = wanted.join(s, "source_id", "left").join(t, "target_id", "left").join(there, KEY, "left").join(ok, ["source_type", "edge_type", "target_type"], "left").join(edge_types, "edge_type", "left")
    outcome = F.when(F.col("source_type").isNull(), "no_source").when(F.col("target_type").isNull(), "no_target").when(F.col("ok").isNull(), "not_allowed").when(F.col("there"), "duplicate").otherwise("added")
    return joined.select(*KEY, "reverse", outcome.alias("outcome"))


def remove_edges(edges: DataFrame, unwanted: DataFrame, edge_types: DataFrame) -> DataFrame:
    """M4: the edges without the unwanted ones and their reverses (a missing reverse is no error)."""
    back = unwanted.join(edge_types, "edge_type").select(F.col("target_id").alias("source_id"), F.col("reverse").alias("edge_type"), F.col("source_id").alias("target_id"))
    return edges.join(unwanted.select(KEY).unionByName(back.select(KEY)), KEY, "left_anti")


def rename(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with ids of ``names`` (old_id, new_id) replaced at both ends."""
    swap = lambda df, c: df.join(names.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return swap(nodes, "id"), swap(swap(edges, "source_id"), "target_id")


def create_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """M6: requested nodes (id ...) with outcome 'created' or 'exists'."""
    known = nodes.select("id").withColumn("there", F.lit(True))
    return fresh.join(known, "id", "left").withColumn("outcome", F.when(F.col("there"), "exists").otherwise("created")).drop("there")


def auto_ids(fresh: DataFrame, nodes: DataFrame, key: str, title: str = "title") -> DataFrame:
    """``fresh`` with ``id``: the slug of its title and a suffix that no other row and no node has.

    ``key`` tells the rows of ``fresh`` apart; a suffix follows from it and the number of the attempt.
    Rows whose id is taken, by a node or by an earlier row, try again: the first attempt settles
    nearly all, and each further one works on what is left."""
    slug = F.coalesce(F.nullif(T.slug(F.col(title)), F.lit("")), F.lit("node"))
    taken, done, attempt = nodes.select("id"), None, 0
    left = fresh
    while True:
        made = checkpoint(left.withColumn("id", F.concat(slug, F.lit("-"), T.make_suffix(F.col(key).cast("string"), F.lit(attempt)))))
        again = made.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(key))).join(taken.withColumn("_t", F.lit(True)), "id", "left")
        judged = checkpoint(again.select(*fresh.columns, "id", (F.col("_t").isNotNull() | (F.col("_n") > 1)).alias("_again")))
        good = judged.filter("not _again").drop("_again")
        done = good if done is None else done.unionByName(good)
        left = judged.filter("_again").drop("_again", "id")
        if left.isEmpty():
            return done
        taken, attempt = taken.unionByName(good.select("id")), attempt + 1


def update_status(nodes: DataFrame, changes: DataFrame, node_types: DataFrame) -> DataFrame:
    """M7: changes (id, new_status) with the prior status and the outcome."""
    n = nodes.select("id", "node_type", F.col("status").alias("prior")).join(node_types.select("node_type", "statuses"), "node_type", "left")
    allowed = F.col("statuses").isNull() | (F.size("statuses") == 0) | F.array_contains("statuses", F.col("new_status"))
    outcome = F.when(F.col("node_type").isNull(), "no_node").when(~allowed, "not_allowed").otherwise("updated")
    return changes.join(n, "id", "left").select("id", "new_status", "prior", outcome.alias("outcome"))


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """M8: provided (non-null) fields of ``changes`` replace those of the node; its body hash follows."""
    fields = [c for c in changes.columns if c != "id"]
    joined = nodes.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    out = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*[f"_{c}" for c in fields])
    return out.withColumn("content_hash", F.sha2("body", 256))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``gone`` (id) and the edges that they own; edges to them dangle."""
    return nodes.join(gone, "id", "left_anti"), edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def index_hash(*columns: str) -> Column:
    """A fingerprint of every indexed value; null differs from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) from two frames of (id, index_hash): insert, delete, replace or keep."""
    o, n = old.select("id", F.col("index_hash").alias("h0")), new.select("id", F.col("index_hash").alias("h1"))
    action = F.when(F.col("h0").isNull(), "insert").when(F.col("h1").isNull(), "delete").when(F.col("h0") != F.col("h1"), "replace").otherwise("keep")
    return o.join(n, "id", "full_outer").select("id", action.alias("action"))


def apply_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """M9: the next index: rows of ``old`` that keep their hash, and all others from ``new``."""
    same = old.join(new.select("id", "index_hash"), ["id", "index_hash"], "left_semi")
    return same.unionByName(new.join(same.select("id"), "id", "left_anti"))


def refreshed(old: DataFrame, new: DataFrame, stored: str | None, wanted: str) -> tuple[DataFrame, bool]:
    """(index, rebuilt): an index of the wanted version takes the changes, one of another version or
    without a readable version is built anew."""
    return (new, True) if stored != wanted else (apply_changes(old, new), False)


def suffix_plan(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(old_id, new_id, outcome) for ids without a suffix: the type in front goes and a suffix comes that no
    node has. Ids whose last part is six characters of the alphabet look alike but may be plain words:
    without a digit they are reported as 'look_alike' and left as they are."""
    tail = F.regexp_extract("id", "-([0-9a-z]{6})$", 1)
    alike = (T.id_suffix(F.col("id")) != "") & ~tail.rlike("[0-9]")
    bare = nodes.filter(T.id_suffix(F.col("id")) == "").select(F.col("id").alias("old_id"), T.strip_prefix(F.col("id"), prefixes).alias("title"))
    made = auto_ids(bare, nodes, "old_id").select("old_id", F.col("id").alias("new_id"), F.lit("rename").alias("outcome"))
    return made.unionByName(nodes.filter(alike).select(F.col("id").alias("old_id"), F.lit(None).cast("string").alias("new_id"), F.lit("look_alike").alias("outcome")))


def schema_deltas(wanted: DataFrame, known: DataFrame, node_types: DataFrame) -> DataFrame:
    """(source_type, edge_type, target_type, outcome) of wanted triples: already present, skipped for an
    unknown source type, or added."""
    key = ["source_type", "edge_type", "target_type"]
    types = node_types.select(F.col("node_type").alias("source_type"), F.lit(True).alias("_s"))
    x = wanted.select(*key).distinct().join(known.select(*key).distinct().withColumn("_k", F.lit(True)), key, "left").join(types, "source_type", "left")
    return x.select(*key, F.when(F.col("_k"), "already_present").when(F.col("_s").isNull(), "skipped_unknown_type").otherwise("added").alias("outcome"))


def upgraded(known: DataFrame, deltas: DataFrame) -> DataFrame:
    """The schema's triples with the added deltas; applying the same deltas again adds nothing."""
    key = ["source_type", "edge_type", "target_type"]
    return known.select(*key).unionByName(deltas.filter("outcome = 'added'").select(*key)).distinct()


def migrate(nodes: DataFrame, edges: DataFrame, types: dict[str, str], statuses: dict[tuple[str, str], str], edge_types: dict[str, str], defaults: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rename node types, statuses (of a type) and edge types; fill null fields with defaults."""
    pick = lambda c, table: F.coalesce(*[F.when(F.col(c) == a, F.lit(b)) for a, b in table.items()], F.col(c)) if table else F.col(c)
    status = F.coalesce(*[F.when((F.col("node_type") == t) & (F.col("status") == a), F.lit(b)) for (t, a), b in statuses.items()], F.col("status"))
    n = nodes.withColumn("status", status).withColumn("node_type", pick("node_type", types))
    n = n.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return n, edges.withColumn("edge_type", pick("edge_type", edge_types))
