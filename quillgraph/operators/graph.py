"""Edges in time, neighbours, traversal and graph statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import ranks
from quillgraph.plans.lineage import checkpoint


def as_of(day: Column) -> Column:
    """the edge is valid on ``day``; an open end passes."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_until").isNull() | (F.col("valid_until") > day))


def current() -> Column:
    """no end is set, not even one in the future."""
    return F.col("valid_until").isNull()


def temporal(edges: DataFrame, mode: str = "current", day: Column | None = None) -> DataFrame:
    """Edges under a mode: 'current' (F4), 'as_of' (F3) or 'history' (F5: all)."""
    if mode == "history":
        return edges
    return edges.filter(current() if mode == "current" else as_of(day))


def visible(status: str = "status") -> Column:
    """superseded nodes are hidden, also under as-of."""
    return F.coalesce(F.col(status), F.lit("")) != "superseded"


def outgoing(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges whose target exists, with the target's columns; optionally of one type."""
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    return e.join(nodes.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"), F.col("title").alias("target_title")), "target_id")


def incoming(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that point to any of ``targets`` (id)."""
    return edges.join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target does not exist."""
    return edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def as_of_join(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root_id, day) rows with the edges of the root that are valid on the day."""
    return roots.join(edges, roots["root_id"] == edges["source_id"]).filter(as_of(F.col("day")))


#: A node's edges are packed into lists of those whose ``edge_idx`` lie in one stretch of so many.
PACK = 4096
#: A candidate's place: its list's number times this and its place in the list, so that they compare as one number.
LIST = 1 << 31
#: Candidates of a root up to which a hop puts them into one row.
WHOLE = 1 << 18
#: Bits of the sieve that tells edges of a frontier from most others: 8 MB, whatever the frontier.
SIEVE = 1 << 26


def _sifted(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose source is among ``ids`` (id), and a few others whose hash is. A semi-join with words of bits, without an exchange of edges."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    bit = lambda h: h.bitwiseAND(63).cast("int")
    words = ids.select(spot("id").alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("_h")))).alias("_bits"))
    h = spot("source_id")
    there = (F.shiftright(h, 6) == F.col("_word")) & (F.call_function("shiftright", F.col("_bits"), bit(h)).bitwiseAND(1) == 1)
    return edges.join(F.broadcast(words), there, "left_semi")


def _fresh(met: DataFrame, old: DataFrame, paths: bool) -> DataFrame:
    """(root_id, id, pos[, path]) of the candidates in lists ``met`` (root_id, pos, tp, stretch, targets[, path]) that are not among the nodes
    ``old`` of a root: a root's lists are put into one row, in order, where a node's first place is found."""
    dealt = met.unionByName(old, allowMissingColumns=True).repartition("root_id")
    held = F.struct("pos", "tp", "stretch", *(["path"] if paths else []), "targets")
    each = dealt.groupBy("root_id").agg(F.sort_array(F.collect_list(held)).alias("l"))
    if not paths:
        of = lambda keep: F.flatten(F.transform(F.filter("l", keep), lambda x: x["targets"]))
        fresh = F.array_except(of(lambda x: x["pos"] >= 0), of(lambda x: x["pos"] < 0))  # each once, in order of first places
        return each.select("root_id", F.posexplode(fresh).alias("pos", "id")).select("root_id", "id", (F.col("pos") + 1).alias("pos"))
    via = lambda x, i, j: F.when(x["pos"] < 0, F.lit(-1).cast("long")).otherwise(i.cast("long") * LIST + j)
    places = F.flatten(F.transform("l", lambda x, i: F.transform(x["targets"], lambda t, j: F.struct(t.alias("id"), via(x, i, j).alias("via")))))
    each = each.select("root_id", F.transform("l", lambda x: x["path"]).alias("p"), F.sort_array(places).alias("c"))
    first = F.filter("c", lambda x, k: (x["via"] >= 0) & F.coalesce(F.get("c", k - 1)["id"] != x["id"], F.lit(True)))
    order = F.sort_array(F.transform(first, lambda x: F.struct(x["via"].alias("via"), x["id"].alias("id"))))
    whole = F.transform(order, lambda x: F.struct(x["id"].alias("id"), F.concat(F.get("p", F.floor(x["via"] / LIST).cast("int")), F.array(x["id"])).alias("path")))
    return each.select("root_id", F.posexplode(whole).alias("pos", "x")).select("root_id", "x.id", (F.col("pos") + 1).alias("pos"), "x.path")


def _fresh_of_hubs(met: DataFrame, old: DataFrame, paths: bool) -> DataFrame:
    """As :func:`_fresh`, where a root meets more than a row should hold: lists are numbered, candidates dealt by root and node and
    positions given by ranges."""
    dealt = met.unionByName(old, allowMissingColumns=True).repartition("root_id")
    numbered = dealt.withColumn("list", F.row_number().over(Window.partitionBy("root_id").orderBy("pos", "tp", "stretch")).cast("long"))
    via = F.when(F.col("pos") < 0, F.lit(-1)).otherwise(F.col("list") * LIST + F.col("place"))
    each = numbered.select("root_id", "pos", "list", *(["path"] if paths else []), F.posexplode("targets").alias("place", "id"))
    each = each.select("root_id", "id", via.alias("via"), *(["path"] if paths else [])).repartition("root_id", "id")
    least = F.min(F.struct("via", "path")).alias("m") if paths else F.min("via").alias("via")  # a number alone is compared without a sort
    first = each.groupBy("root_id", "id").agg(least)
    first = (first.select("root_id", "id", "m.*") if paths else first).filter("via >= 0")
    placed = ranks.numbered(checkpoint(first), ["root_id"], [F.col("via")], "pos")
    return placed.withColumn("path", F.concat("path", F.array("id"))) if paths else placed


def bfs(roots: DataFrame, nodes: DataFrame, edges: DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame], max_depth: int, edge_types: Sequence[str] = (), paths: bool = True) -> DataFrame:
    """V1, V2, V4: breadth-first from all ``roots`` (root_id) at once: (root_id, id, depth, pos, path), the last if ``paths``.

    A root that does not exist has no row. A node is reached once, by the candidate with the
    smallest (parent's position, type position, edge_idx); ``edge_types`` orders neighbours
    by its own order and an empty list admits all. ``edges`` may be a function that applies a filter of sources to the edges
    where it is cheapest, say before they are numbered. Each hop looks only at edges of nodes that its frontier holds, packs them into lists
    and joins these with the frontier; the lists that it meets and what is known are dealt by root once. Degrees bound beforehand what
    a root can meet: where that is more than a row should hold, rows are dealt by root and node and positions given by
    ranges. Hops but the last are written out; the driver sees that bound alone."""
    chosen = F.col("edge_type").isin(list(edge_types)) if edge_types else F.lit(True)
    rank = F.coalesce(*[F.when(F.col("edge_type") == t, i) for i, t in enumerate(edge_types)]) if edge_types else F.lit(0)
    there = nodes.select(F.col("id").alias("target_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("edge_idx", "target_id"))), lambda x: x["target_id"])
    known = roots.select("root_id").distinct().join(nodes.select(F.col("id").alias("root_id")), "root_id", "left_semi")
    path = [F.array("root_id").alias("path")] if paths else []
    reached = checkpoint(known.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"), F.lit(0).alias("pos"), *path))
    frontier = reached
    for depth in range(1, max_depth + 1):
        sift = lambda e, ids=frontier.select("id"): _sifted(e, ids)
        near = (edges(sift) if callable(edges) else sift(edges)).filter(chosen).join(there, "target_id", "left_semi").select(F.col("source_id").alias("id"), "target_id", rank.alias("tp"), "edge_idx")
        lists = checkpoint(near.groupBy("id", "tp", F.floor(F.col("edge_idx") / PACK).alias("stretch")).agg(listed.alias("targets")))
        degrees = frontier.select("root_id", "id").join(lists.select("id", F.size("targets").alias("n")), "id")
        most = degrees.groupBy("root_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if not most:
            break
        met = frontier.join(lists, "id").drop("id", "depth")
        old = reached.select("root_id", F.lit(-1).alias("pos"), F.lit(0).alias("tp"), F.lit(0).cast("long").alias("stretch"), F.array("id").alias("targets"))
        fresh = (_fresh if most <= min(WHOLE, ranks.HUB) else _fresh_of_hubs)(met, old, paths)
        fresh = fresh.withColumn("depth", F.lit(depth)).withColumn("pos", F.col("pos").cast("int")).select(*reached.columns)
        frontier = checkpoint(fresh) if depth < max_depth else fresh  # the last level is read by the caller alone
        reached = reached.unionByName(frontier)
    return reached


def distances(roots: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int, carried: Sequence[str] = ()) -> DataFrame:
    """V1 without positions: (root_id, id, depth, ``carried`` columns of the node), all rows of a root in one partition.

    What :func:`bfs` reaches, for callers that need no order of neighbours. Only edges of nodes that the frontier holds are looked at;
    their targets bring their own columns along, so that what is reached, which is many times the edges, is
    dealt by root once a hop and never meets the nodes again."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = nodes.select("id", *carried)
    reached = roots.select("root_id").distinct().join(own.withColumnRenamed("id", "root_id"), "root_id").select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"), *carried)
    arrays = ["id", *carried]
    for depth in range(1, max_depth + 1):
        reached = checkpoint(reached)
        frontier = reached.filter(F.col("depth") == depth - 1).select("root_id", F.col("id").alias("source_id"))
        near = edges.select("source_id", "target_id").join(frontier.select("source_id").distinct(), "source_id", "left_semi").join(own.withColumnRenamed("id", "target_id"), "target_id").withColumnRenamed("target_id", "id")
        place = F.row_number().over(Window.partitionBy("source_id").orderBy("id"))
        packed = F.collect_list(F.struct(*arrays))
        lists = near.withColumn("stretch", F.floor(place / PACK)).groupBy("source_id", "stretch").agg(packed.alias("_t"))
        lists = lists.select("source_id", *[F.col("_t")[c].alias(c) for c in arrays])
        met = frontier.join(lists, "source_id").select("root_id", F.lit(depth).alias("depth"), *arrays)
        old = reached.select("root_id", "depth", *[F.array(c).alias(c) for c in arrays])
        each = met.unionByName(old).repartition(n, "root_id").select("root_id", "depth", F.explode(F.arrays_zip(*arrays)).alias("_t")).select("root_id", "depth", "_t.*")
        reached = each.groupBy("root_id", "id").agg(F.min("depth").alias("depth"), *[F.max(c).alias(c) for c in carried])
    return reached


def resolve(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queries (query) to ids: (query, id, outcome). A query is a file name (with or without folders and ".md"), a
    whole id, the six-character suffix of an id, or the number after an id's last dash, tried in this order; two hits of one kind are ambiguous."""
    name = F.regexp_replace("file_path", r"^.*/|\.md$", "") if "file_path" in nodes.columns else F.lit(None).cast("string")
    k = lambda rank, key: F.struct(F.lit(rank).alias("rank"), key.alias("_q"))
    keys = F.array(k(0, name), k(1, F.col("id")), k(2, F.regexp_extract("id", T.SUFFIX, 2)), k(3, F.regexp_extract("id", "-([0-9]+)$", 1)))
    keyed = nodes.select("id", F.explode(keys).alias("k")).select("id", "k.*").filter("_q is not null and _q <> ''")
    q = asked.select("query").distinct().withColumn("_q", F.regexp_replace("query", r"^.*/|\.md$", ""))
    found = q.join(keyed, "_q", "left").groupBy("query", "rank").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).groupBy("query").agg(F.min(F.struct("rank", "n", "id")).alias("m"))
    return found.select("query", F.when(F.col("m.n") == 1, F.col("m.id")).alias("id"), F.when(F.col("m.n") == 0, "none").when(F.col("m.n") == 1, "found").otherwise("ambiguous").alias("outcome"))


def hop_score(depth: Column) -> Column:
    """1.0, 0.8, 0.5, then 0.1 less for each hop but at least 0.3."""
    return F.when(depth == 0, 1.0).when(depth == 1, 0.8).when(depth == 2, 0.5).otherwise(F.greatest(F.lit(0.3), 0.5 - 0.1 * (depth - 2)))


def scored(reached: DataFrame) -> DataFrame:
    """V3: reached nodes with their hop score."""
    return reached.withColumn("score", hop_score(F.col("depth")))


def with_payload(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """V5: reached nodes with type, status and title."""
    return reached.join(nodes.select("id", "node_type", "status", "title"), "id")


def type_counts(nodes: DataFrame) -> DataFrame:
    """A1: nodes by type."""
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1, A2: one row of node, edge and distinct-edge counts."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("node_type").alias("n_types"))
    e = edges.groupBy("source_id", "target_id", "edge_type").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n_edges"), F.count(F.lit(1)).alias("n_distinct_edges"))
    return n.join(e, F.lit(True))


def listing(nodes: DataFrame, limit: int = 50, **equal: str | None) -> DataFrame:
    """K2, O1, F1: equality filters (unset: none), newest first (null last), then id."""
    out = nodes
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(F.col("updated").desc_nulls_last(), "id").limit(limit)
