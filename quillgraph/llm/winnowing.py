"""Operator 13: document fingerprints by winnowing.

A text's fingerprint is made of the hashes of its k-grams of code points: of each window of ``window``
k-grams in a row the least hash is chosen, the rightmost on ties, and kept with its position. Two texts
that share a passage of ``k + window - 1`` code points or more share a whole window, so they share a
fingerprint of it; the kept positions tell where."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm._spark import by_value, let

by_value(__name__)
K, WINDOW = 16, 24
#: Code points of a text that are hashed at a time: memory does not grow with a text beyond its own code points.
BLOCK = 1 << 20
#: Ranges of ids for each partition, so that partitions made of whole ranges are of near-equal size.
RANGES = 4
BASE = 0x9E3779B97F4A7C15
#: An entry of a packed fingerprint: a hash, and its distance from the entry before (from the text's beginning for the first).
ENTRY = np.dtype([("hash", ">u4"), ("gap", "u1")])


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The 32-bit hash of each k-gram. Polynomial hashes of length 1, 2, 4, ... are joined, so a
    gram costs the logarithm of its length."""
    old = np.seterr(over="ignore")
    try:
        piece, width = points.astype(np.uint64) + np.uint64(1), 1
        whole, length = None, 0
        while True:
            if k & width:
                if whole is None:
                    whole = piece
                else:  # the part so far, then this piece
                    n = len(points) - (length + width) + 1
                    whole = whole[:n] * np.uint64(pow(BASE, width, 1 << 64)) + piece[length : length + n]
                length += width
            width *= 2
            if width > k:
                break
            half = width // 2
            piece = piece[:-half] * np.uint64(pow(BASE, half, 1 << 64)) + piece[half:]
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (whole ^ (whole >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
    finally:
        np.seterr(**old)


def least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of each window."""
    width, out = 1, keys
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(text: str, k: int = K, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps, by position. A text of fewer than k code points is one gram,
    one of fewer than ``window`` grams is one window; an empty text has none."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(k, len(text))
    grams = len(text) - k + 1
    window = min(window, grams)
    hashes, places = [], []
    for start in range(0, grams - window + 1, block):
        count = min(block, grams - window + 1 - start)  # windows that begin in this block
        points = np.frombuffer(text[start : start + count + window + k - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = gram_hashes(points, k)
        at = np.arange(len(h), dtype=np.uint64)
        keys = least(h << np.uint64(32) | (np.uint64(0xFFFFFFFF) - at), window)  # the rightmost of equal hashes is the least key
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
        hashes.append(keys >> np.uint64(32))
        places.append((np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64) + start)
    h, p = np.concatenate(hashes), np.concatenate(places)
    first = np.r_[True, p[1:] != p[:-1]]  # a block's first window may choose what the last one of the block before chose
    return h[first], p[first]


def packed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as hex digits: eight of a hash and two of its gap, entry after entry. Gaps never exceed the window."""
    out = np.empty(len(hashes), ENTRY)
    out["hash"], out["gap"] = hashes, np.diff(positions, prepend=0)
    return out.tobytes().hex()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a packed fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), ENTRY)
    return rows["hash"].astype(np.uint64), np.cumsum(rows["gap"].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of both fingerprints' entries whose hash the other has too, each entry matched once (Dice's
    coefficient of multisets); 1 for two texts without any."""
    if not len(a) and not len(b):
        return 1.0
    (u, m), (v, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return 2 * int(np.minimum(m[i], n[j]).sum()) / (len(a) + len(b))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, guest, id, text): each row with the one after it. A range's guest is the first row of
    the range that follows; it is read, not returned. Two texts are held at a time."""
    before: tuple | None = None
    for batch in batches:
        done: list[tuple] = []
        for r in range(batch.num_rows):
            place, guest, own, text = (batch.column(c)[r].as_py() for c in ("range", "guest", "id", "text"))
            text = text or ""
            if before is None and guest:
                continue  # a repeated guest
            now = winnow(text)
            if before is not None:
                if before[0] != place:
                    raise RuntimeError("a range lies in more than one partition")
                _, id_, old, mark = before
                q = len(old) // 4
                edited = old[: len(old) - q] + text[:q]
                other = winnow(edited)
                done.append((id_, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(*mark), packed(*other), likeness(mark[0], other[0]), likeness(mark[0], now[0])))
            before = None if guest else (place, own, text, now)
        if done:
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _ranges(key: Column, firsts: list, kind: str) -> Column:
    """[(range, guest)] of an id: the range whose first id is the last not beyond it; as guest, the range before the one that
    it begins (the last for the first). Ids are found among every ``step``-th first id, then between two of these."""
    step = max(1, math.isqrt(len(firsts)))
    literal = lambda xs: F.from_json(F.lit(json.dumps([{"id": x} for x in xs], default=str)), f"array<struct<id:{kind}>>")  # noqa: E731  folds to a literal
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x <= k))

    def places(k: Column, all_: Column, coarse: Column) -> Column:
        number = let(count(coarse, k), lambda c: (c - 1) * step + count(F.slice(all_, (c - 1) * step + 1, F.lit(step)), k) - 1)
        place = lambda n, guest: F.struct(n.cast("int").alias("range"), F.lit(guest).alias("guest"))
        return let(number, lambda n: F.array_compact(F.array(place(n, False), F.when(F.get(all_, n) == k, place(F.pmod(n - 1 + len(firsts), F.lit(len(firsts))), True)))))

    return let(F.struct(key.alias("id")), lambda k: let(literal(firsts), lambda a: let(literal(firsts[::step]), lambda c: places(k, a, c))))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next
    document, by ascending id (null ids first, rows of one id by their texts' hashes, after the last the first).
    Likeness is the share of the two fingerprints' entries that the other has too, from 0 to 1.

    The texts are shuffled once, into ranges of ids whose ends come from a pass over the ids alone (one id a
    range comes to the driver); the row that begins a range goes to the range before it too, so each
    document meets its next one whatever the partitions are. A partition is read as a stream. Null text is
    empty: its fingerprint is '', alike (1) only to that of another empty text. A text of any length is read whole,
    a block at a time. Repeated rows each get a row. Other columns are not read, whatever their names; an
    empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = docs.select(F.col(id_col).alias("id"))
    ends = key.repartitionByRange(RANGES * n, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id")).alias("first")).collect()
    firsts = [r["first"]["id"] for r in sorted(ends, key=lambda r: r["part"])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", F.explode(_ranges(F.col("id"), firsts or [None], kind)).alias("_at")).select("_at.range", "_at.guest", "id", "text")
    ranged = rows.repartitionById(n, F.floor(F.col("range") / RANGES).cast("int")).withColumn("h", F.xxhash64("text")).sortWithinPartitions("range", "guest", "id", "h")
    return ranged.select("range", "guest", "id", "text").mapInArrow(_pairs, ddl)
