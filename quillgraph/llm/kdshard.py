"""Sharding by a k-d tree over document metadata.

A node that has to give k shards is split along its widest dimension at the weighted
quantile that leaves floor(k / 2) of k shares of its bytes on the left, until every
leaf is one shard. All quantiles of a level are found together, by histograms that
Spark counts over all rows: the driver holds the tree (a node for each shard) and the
histograms' chosen bins, never rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm._spark import checkpoint, let

#: Bins of a histogram and how often the chosen bin is cut again: 12 bits of a coordinate each time.
BIN_BITS = 12
ROUNDS = 4


@dataclass
class Node:
    """Rows whose coordinates satisfy ``where``; it gives ``shards`` shards from number ``first`` on."""

    first: int
    shards: int
    where: Callable[[Column], Column]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _axes(docs: DataFrame, text: str, dimensions: tuple[str, ...]) -> list[Column]:
    """A 48-bit coordinate a dimension, its last 12 bits still 0.

    The value's rank bits are on top (24), then 12 bits of the text's hash."""
    copies = F.shiftrightunsigned(_text_hash(text), 52)
    axes = []
    for d in dimensions:
        value = F.col(f"`{d}`")
        if docs.schema[d].dataType.typeName() in ("string", "binary", "boolean"):  # the hash spreads categories along the axis
            top = F.shiftrightunsigned(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), 40)
        else:  # a log scale for counts
            top = F.least(F.lit(float((1 << 24) - 1)), F.log2(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * (1 << 18)).cast("long")
        axes.append(top * (1 << 24) + copies * (1 << 12))
    return axes


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _single(id_col: str, text: str) -> Column:
    """12 bits of a row's own: with them no value, not even one that all rows share, is too heavy to split."""
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), _text_hash(text)), 52)


def _points(docs: DataFrame, id_col: str, text: str, dimensions: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A compact row for each document (id, size, crc, x: one coordinate a dimension), and the points of its groups (h, least).

    Rows of equal texts form a group, of any size. A group of several rows lies at the least of its
    rows' coordinates, whatever their metadata, and only the last 12 bits are a row's own: on every
    axis a group is one stretch, so it stays together unless a cut falls inside it, and then its rows
    on either side still do. Only counts and the least coordinates of a group are gathered, never its
    rows; Spark splits the rows of a hot group in the join."""
    t = F.col(f"`{text}`")
    rows = checkpoint(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            size_of(t).alias("size"),
            F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
            _text_hash(text).alias("h"),
            F.array(*_axes(docs, text, dimensions)).alias("x"),
            _single(id_col, text).alias("own"),
        )
    )
    groups = checkpoint(rows.groupBy("h").agg(F.min("x").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "least"))
    return checkpoint(rows.join(_sized(groups), "h", "left").select("id", "size", "crc", _placed("x", "own").alias("x"))), groups


#: Groups of equal texts up to which their points are broadcast; a point is a hash and a short array, some 100 bytes.
BROADCAST_GROUPS = 1 << 16


def _sized(groups: DataFrame) -> DataFrame:
    """``groups`` to be broadcast if they are counted to be few; Spark does not know the size of what was checkpointed."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _placed(x: str, own: str) -> Column:
    """The group's coordinates where there is a group, else the row's, with the row's own bits below."""
    return F.transform(F.coalesce("least", x), lambda v: v + F.col(own))


def _cuts(rows: DataFrame, level: list[Node], dims: int) -> list[tuple[int, int]]:
    """(dimension, cut) for each node of a level: rows below the cut go left."""
    numbered = F.coalesce(*[F.when(n.where(F.col("x")), F.lit(k)) for k, n in enumerate(level)])
    spread = rows.groupBy(numbered.alias("node")).agg(
        F.sum("size").alias("bytes"),
        *[F.min(F.get("x", d)).alias(f"lo{d}") for d in range(dims)],
        *[F.max(F.get("x", d)).alias(f"hi{d}") for d in range(dims)],
        *[F.stddev_pop(F.get("x", d)).alias(f"sd{d}") for d in range(dims)],
    )
    seen = {r["node"]: r for r in spread.filter("node is not null").collect()}
    axis, low, width, target, last = [], [], [], [], [0] * len(level)
    for k, n in enumerate(level):
        r = seen.get(k)
        axis.append(max(range(dims), key=lambda d: (r[f"sd{d}"] or 0.0, -d)) if r else 0)
        low.append(r[f"lo{axis[k]}"] if r else 0)
        width.append((r[f"hi{axis[k]}"] - low[k] + 1) if r else 1)
        target.append((r["bytes"] * (n.shards // 2) / n.shards) if r else 0.0)
    for _ in range(ROUNDS):
        step = [max(1, -(-w >> BIN_BITS)) for w in width]
        if all(w <= 1 for w in width):
            break
        at = F.coalesce(*[F.when(n.where(F.col("x")), F.when(F.get("x", axis[k]).between(low[k], low[k] + width[k] - 1), F.lit(k) * (1 << BIN_BITS + 1) + F.floor((F.get("x", axis[k]) - low[k]) / step[k]))) for k, n in enumerate(level)])
        bins = rows.groupBy(at.alias("bin")).agg(F.sum("size").alias("bytes")).filter("bin is not null")
        running = F.sum("bytes").over(Window.partitionBy(F.expr(f"shiftright(bin, {BIN_BITS + 1})")).orderBy("bin"))
        goal = F.coalesce(*[F.when(F.expr(f"shiftright(bin, {BIN_BITS + 1})") == k, F.lit(float(target[k]))) for k in range(len(level))])
        chosen = bins.select("bin", "bytes", running.alias("upto")).filter(F.col("upto") >= goal).groupBy(F.expr(f"shiftright(bin, {BIN_BITS + 1})").alias("node")).agg(F.min(F.struct("bin", "bytes", "upto")).alias("b"))
        picked = {r["node"]: r["b"] for r in chosen.collect()}
        for k in range(len(level)):
            b = picked.get(k)
            if b is None:
                width[k] = 1
                continue
            bin_no = b["bin"] & ((1 << BIN_BITS + 1) - 1)
            last[k] = b["bytes"]
            target[k] -= b["upto"] - b["bytes"]
            low[k], width[k] = low[k] + bin_no * step[k], step[k]
    # the bin that the target falls in goes to the side that misses the target by less
    return [(axis[k], low[k] + (width[k] if 2 * target[k] >= last[k] else 0)) for k in range(len(level))]


def tree(rows: DataFrame, shards: int, dims: int) -> list[Node]:
    """The leaves, in shard order."""
    leaves: list[Node] = []
    level = [Node(0, shards, lambda x: F.lit(True))]
    while level:
        leaves += [n for n in level if n.shards == 1]
        level = [n for n in level if n.shards > 1]
        if not level:
            break
        nodes = []
        for n, (axis, cut) in zip(level, _cuts(rows, level, dims), strict=True):
            nodes.append(Node(n.first, n.shards // 2, lambda x, w=n.where, a=axis, c=cut: w(x) & (F.get(x, a) < c)))
            nodes.append(Node(n.first + n.shards // 2, n.shards - n.shards // 2, lambda x, w=n.where, a=axis, c=cut: w(x) & (F.get(x, a) >= c)))
        level = nodes
    return sorted(leaves, key=lambda n: n.first)


def number_of(leaves: list[Node], x: Column) -> Column:
    """The shard of a row with the coordinates ``x``, which are computed once."""
    return let(x, lambda v: F.coalesce(*[F.when(n.where(v), F.lit(n.first)) for n in leaves]).cast("int"))


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each ``shard``, in the order of ``order``.

    The rows are range-partitioned and sorted once and written; a shard may lie in many
    partitions. The counts of each (partition, shard) give each part its first slot."""
    ranged = rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    placed = checkpoint(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", "shard", "_from", F.coalesce(before, F.lit(0)).alias("_first"))
    joined = placed.join(starts, ["_part", "shard"])
    return joined.withColumn("slot", F.col("_at") - F.col("_from") + F.col("_first")).drop("_part", "_at", "_from", "_first")


def assign(docs: DataFrame, shards: int = 40, target_bytes: int | None = None, id_col: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """(id, size, crc, shard, slot) for each row of ``docs``; shards have near-equal bytes.

    Equal texts lie together on every axis and are parted only where a cut falls among them.
    With ``target_bytes`` the number of shards follows from the total instead. Null
    metadata is a value of its own (an empty category, a count of 0); a null text has
    16 bytes and CRC 0. A very long text is one row and goes whole to one shard, which it may fill.
    Repeated rows are placed one by one: rows alike in text and id share a
    coordinate and so a shard. Other columns are not read, whatever their names.
    An empty table gives an empty result."""
    rows, _ = _points(docs, id_col, text, dimensions)
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    leaves = tree(rows, shards, len(dimensions))
    return with_slots(rows.select("id", "size", "crc", number_of(leaves, F.col("x")).alias("shard")), ["crc", "id"])


def shard_docs(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """``docs`` with ``shard`` added, by the rule of :func:`assign`: the tree is fitted on compact rows, then
    applied to each row where it is. Texts move only if there are more groups of equal texts than
    ``BROADCAST_GROUPS``. A column named shard is replaced. Nulls, long texts, repeated rows and an
    empty table: as :func:`assign`."""
    rows, groups = _points(docs, id_col, text, dimensions)
    leaves = tree(rows, shards, len(dimensions))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("_row")
    placed = docs.select(row, _text_hash(text).alias("h"), F.array(*_axes(docs, text, dimensions)).alias("_x"), _single(id_col, text).alias("_own"))
    x = _placed("_x", "_own")
    return placed.join(_sized(groups), "h", "left").select("_row.*", number_of(leaves, x).alias("shard"))
