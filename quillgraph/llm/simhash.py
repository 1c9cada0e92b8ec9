"""Near copies by SimHash, compared bit-sliced.

Fingerprints that are close agree exactly in some pieces (the pigeonhole), so only
those that share pieces are compared. Within such a bucket 64 fingerprints at a time
are held as 64 bit planes; a query's distances to all of them are added up in carry-save
counters, and a block is given up once all its distances exceed the radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._spark import ascii_lower, by_value, checkpoint, let, words
from quillgraph.llm.components import components

by_value(__name__)
BITS = 64
SHINGLE = 4
RADIUS = 4
#: A bucket larger than this is compared chunk by chunk, each pair of chunks a task's group of its own.
CHUNK = 4096
#: Rows that a task gathers before it compares the whole buckets among them.
GATHER = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle of ``size`` words; of the whole sequence if it is shorter."""

    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))

    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), hashed)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) for each row: bit j of fp is set if over half of the shingle hashes have it.

    Two bit counts ride in each long (bits j and j + 32), so 32 sums count all bits;
    the shingles of a row meet in its own task before the shuffle of one row a document.
    Null or empty texts have fingerprint 0; repeated rows each keep a row."""
    pair = F.lit((1 << 32) | 1)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("_row"), shingle_hashes(F.col(f"`{text}`")).alias("_h"))
    each = rows.select("id", "_row", F.explode_outer("_h").alias("h"))
    sums = each.groupBy("_row", "id").agg(F.count("h").alias("n"), *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair)).alias(f"s{j}") for j in range(32)])
    bits = []
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for at, count in ((j, low), (j + 32, high)):
            bits.append(F.when(2 * count > F.col("n"), F.lit((1 << at) - (1 << 64) * (at == 63))).otherwise(F.lit(0)).cast("long"))
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select("id", fp.alias("fp"))


def layout(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The tables of key pieces [(first bit, width), ...] for ``n`` fingerprints.

    64 bits are cut into p pieces. Two fingerprints within the radius agree in at least
    p - radius of them, so any table layout finds every pair; the choice of p only weighs
    the rows written (each table copies all keys) against the pairs compared in buckets."""

    def cost(p: int) -> float:
        keep = p - radius
        bits = keep * BITS / p
        return comb(p, keep) * n * (1.0 + 0.0025 * n / 2.0**bits)

    p = min(range(radius + 1, radius + 6), key=cost)
    edges = [round(k * BITS / p) for k in range(p + 1)]
    pieces = list(zip(edges, (b - a for a, b in zip(edges, edges[1:])), strict=False))
    return [list(c) for c in combinations(pieces, p - radius)]


def _planes(block: np.ndarray) -> np.ndarray:
    """(blocks, 64) fingerprints to (64, blocks) bit planes: lane l of plane i is bit i of member l."""
    bits = np.unpackbits(block.view(np.uint8).reshape(len(block), BITS, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (block[k], query[k]): the pairs that survive, and the lanes within the radius.

    c0, c1, c2 count the differing bits of all 64 lanes (c2 is the four's place); ``over``
    stays set once a lane reaches eight. Three planes are added by one carry-save adder."""
    at = np.arange(len(block))
    c0, c1, c2, over = (np.zeros(len(block), np.uint64) for _ in range(4))
    for first in range(0, BITS, 3):
        d = []
        for i in range(first, min(first + 3, BITS)):
            spread = np.uint64(0) - ((query >> np.uint64(i)) & np.uint64(1))
            d.append(planes[i, block] ^ spread)
        d += [np.zeros_like(c0)] * (3 - len(d))
        half = d[0] ^ d[1]
        ones, twos = half ^ d[2], (d[0] & d[1]) | (half & d[2])
        carry = c0 & ones
        c0 = c0 ^ ones
        half = c1 ^ twos
        fours = (c1 & twos) | (half & carry)
        c1 = half ^ carry
        over |= c2 & fours
        c2 = c2 ^ fours
        if first % 9 == 6:
            alive = _beyond(c0, c1, c2, over, radius) != ALL
            if not alive.all():
                at, block, query, c0, c1, c2, over = (x[alive] for x in (at, block, query, c0, c1, c2, over))
                if not len(at):
                    break
    return at, ~_beyond(c0, c1, c2, over, radius)


def _beyond(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """The lanes whose count so far exceeds the radius (0 to 7)."""
    bigger = over.copy()
    same = ~over
    for bit, c in ((4, c2), (2, c1), (1, c0)):
        if radius & bit:
            same = same & c
        else:
            bigger |= same & c
            same = same & ~c
    return bigger


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least member of each local component after links a-b."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _compare(group: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Local components over all groups: ``group`` ascends; the least member of each row's component."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    blocks = -(-sizes // BITS)
    first = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(group)) - starts[own]
    home, lane = first[own] + within // BITS, within % BITS
    members = np.zeros((int(blocks.sum()), BITS), np.uint64)
    members[home, lane] = fp
    valid = np.zeros(len(members), np.uint64)
    np.bitwise_or.at(valid, home, np.uint64(1) << lane.astype(np.uint64))
    rows = np.full((len(members), BITS), -1, np.int64)
    rows[home, lane] = np.arange(len(group))
    planes, root = _planes(members), np.arange(len(group))
    ends = np.cumsum(blocks[own] - within // BITS)  # each row is a query to its own block and those after it
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16384, "right")))
        q = np.arange(at, to)
        many = blocks[own[q]] - within[q] // BITS
        query = np.repeat(q, many)
        block = home[query] + (np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many))
        kept, near = _within(planes, block, fp[query], radius)
        near &= valid[block[kept]]
        hit = near != 0
        if hit.any():
            bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, l = np.nonzero(bits)
            a, b = query[kept[hit]][k], rows[block[kept[hit]][k], l]
            other = a != b
            if other.any():
                root = _roots(len(group), a[other], b[other], root)
        at = to
    return root


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (g, fp, rep) to star links (u, v) of each bucket's local components."""

    kind = pa.int64()

    def done(g: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = np.r_[g[1:] == g[:-1], False] | np.r_[False, g[1:] == g[:-1]]
        g, fp, rep = g[many], fp[many], rep[many]
        if len(g):
            root = _compare(g, fp, radius)
            far = root != np.arange(len(root))
            if far.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[far], kind), pa.array(rep[root[far]], kind)], names=["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        kind = batch.schema.field("rep").type
        if batch.num_rows:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            size += batch.num_rows
        if size >= GATHER:
            g, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(g, g[-1], "left"))  # the last bucket may go on
            yield from done(g[:cut], fp[:cut].view(np.uint64), rep[:cut])
            held, size = [(g[cut:], fp[cut:], rep[cut:])], len(g) - cut
    if size:
        g, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from done(g, fp.view(np.uint64), rep)


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links over ``rep`` (of any type with an order) that join all of ``prints`` (fp, rep; fp distinct) within the radius.

    Each bucket gives the links of a star for each of its local components, not all pairs.
    A bucket of more than ``chunk`` rows is dealt into chunks, and each pair of chunks is
    a bucket of its own: a row is copied once for each chunk, and all pairs are still met."""
    tables = layout(prints.count(), radius)

    def key(pieces: list[tuple[int, int]]) -> Column:
        return F.xxhash64(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in pieces])

    keyed = prints.select("fp", "rep", F.posexplode(F.array(*[key(t) for t in tables])).alias("t", "k"))
    hot = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    hot = hot.select("t", "k", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    c, own = F.coalesce(F.col("c"), F.lit(1)), F.pmod(F.xxhash64("fp", "t"), F.coalesce(F.col("c"), F.lit(1)).cast("long"))
    cells = F.when(c > 1, F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.xxhash64("t", "k", F.least(j.cast("long"), own), F.greatest(j.cast("long"), own)))).otherwise(F.array(F.xxhash64("t", "k")))
    grouped = keyed.join(hot, ["t", "k"], "left").select(F.explode(cells).alias("g"), "fp", "rep")
    dealt = grouped.repartition("g").sortWithinPartitions("g")
    kind = prints.schema["rep"].dataType.simpleString()
    return dealt.mapInArrow(lambda batches: _link(batches, radius), f"u {kind}, v {kind}")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that links reach. Equal fingerprints are one
    node, however many copies there are. Texts without words have fingerprint zero and
    link like any other. A row whose id is null takes part through its fingerprint but
    lends no id (null if its class has none). A very long text is as many rows as it has
    shingles before they are counted. Ids have any type with an order. Other columns are not
    read, whatever their names; an empty table gives an empty result."""
    prints = checkpoint(fingerprints(docs, id_col, text))
    nodes = checkpoint(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each class stays, that with the smallest id, with its columns as they were.

    Of several rows with that id the first by a hash of all columns stays; rows
    whose id is null cannot be named by a class and stay. Columns have any names. Null,
    empty and long texts as :func:`classes`; an empty table gives an empty result."""
    keep = classes(docs, id_col, text, radius).filter(F.col("id") == F.col("component_id")).select(F.col("id").alias("_keep")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_keep"), row.alias("_row")).join(keep, "_keep", "left_semi")
    first = kept.groupBy("_keep").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return first.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
