"""Benchmark decontamination by suffix arrays of the training texts.

Each task sorts the word suffixes of its documents into suffix arrays (one for each
block of a bounded number of words) and binary-searches every test suffix in them, by its
first 13 words: the range that a search returns holds all places where these occur word for
word. Places that go on word by word on the same diagonal (the same distance between item and
document) are one verbatim match, so its length and location follow from the places alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm._spark import by_value

by_value(__name__)
WINDOW = 13
#: Words of documents that one suffix array holds (a longer document has one of its own).
BLOCK_WORDS = 1 << 20
#: Bytes of item texts that are searched for in one pass over the documents.
ITEM_BYTES = 2 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Items:
    """Test windows ready for binary search: ``low``/``high`` bound the suffixes that begin with each.

    Window k occurs in the item rows ``row[first[k] : first[k + 1]]`` at the word positions ``at``;
    ``name`` numbers the id (in ``names``) of each item row."""

    vocabulary: dict[bytes, int]
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    first: np.ndarray
    row: np.ndarray
    at: np.ndarray
    name: np.ndarray
    names: list[str]
    least: int


def tokens(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def prepare(rows: list[tuple[str, str | None]], window: int = WINDOW) -> Items:
    """The distinct windows of the items and, for each, where the items have it."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for r, (_, text) in enumerate(rows):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)]
        for k in range(max(1, len(ids) - window + 1)) if ids else ():
            found.setdefault(tuple(ids[k : k + window]), []).append((r, k))
    keys = sorted(found)
    low = np.zeros((len(keys), window), ">u4")
    high = np.full((len(keys), window), 0xFFFFFFFF, ">u4")
    for k, key in enumerate(keys):
        low[k, : len(key)] = high[k, : len(key)] = key
    places = np.array([p for key in keys for p in found[key]], np.int64).reshape(-1, 2)
    return Items(
        vocabulary,
        _sortable(low),
        _sortable(high),
        np.array([len(key) for key in keys], np.int64),
        np.r_[0, np.cumsum([len(found[key]) for key in keys])].astype(np.int64),
        places[:, 0],
        places[:, 1],
        np.array([number[name] for name, _ in rows], np.int64),
        names,
        min(map(len, keys), default=window),
    )


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Rows of big-endian word numbers as byte strings, whose order is the order of the rows."""
    return np.ascontiguousarray(keys).view(f"S{4 * keys.shape[1]}")[:, 0]


def suffix_array(words: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, starts) of the suffixes, each cut at the first 0 and at ``width`` words.

    0 is a word that no item has or the end of a document. Suffixes of fewer than
    ``least`` words before it can hold no window and are left out."""
    zero = np.flatnonzero(words == 0)
    room = np.append(zero, len(words))[np.searchsorted(zero, np.arange(len(words)))] - np.arange(len(words))
    starts = np.flatnonzero(room >= least)
    padded = np.append(words, np.zeros(width, words.dtype))
    keys = np.zeros((len(starts), width), ">u4")
    for k in range(width):
        keys[:, k] = np.where(room[starts] > k, padded[starts + k], 0)
    flat = _sortable(keys)
    order = np.argsort(flat, kind="stable")
    return flat[order], starts[order]


#: A verbatim match: item id, first word in the item, first word in the document, words.
Match = tuple[str, int, int, int]
#: Pairs of places in items and documents that are held at a time (but for one document, which is whole).
PAIRS = 1 << 21


def search(block: list[list[bytes]], items: Items) -> list[tuple[list[int], list[Match]]]:
    """For each document of a block: merged [start, end) word spans of all hits, flattened, and its longest match with each item."""
    get = items.vocabulary.get
    sizes = np.array([len(d) for d in block])
    begin = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(block), np.uint32)
    for at, doc in zip(begin, block, strict=True):
        words[at : at + len(doc)] = [get(w, 0) for w in doc]
    keys, starts = suffix_array(words, items.least, WINDOW)
    lo, hi = np.searchsorted(keys, items.low, "left"), np.searchsorted(keys, items.high, "right")
    many = hi - lo
    window = np.repeat(np.arange(len(lo)), many)
    place = starts[np.repeat(lo, many) + np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)]
    out: list[tuple[list[int], list[Match]]] = [([], []) for _ in block]
    if not len(place):
        return out
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + items.length[window], -1)
    hit = np.r_[0, (np.cumsum(edge) > 0).astype(np.int8), 0]
    turns = np.flatnonzero(np.diff(hit))
    opens, closes = turns[::2], turns[1::2]
    for doc, a, b in zip(np.searchsorted(begin, opens, "right") - 1, opens, closes, strict=True):
        out[doc][0].extend((int(a - begin[doc]), int(b - begin[doc])))
    order = np.argsort(place, kind="stable")
    window, place = window[order], place[order]
    doc = np.searchsorted(begin, place, "right") - 1
    pairs = np.cumsum(items.first[window + 1] - items.first[window])
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))  # where a document's hits end
    at = 0
    while at < len(doc):
        to = int(ends[min(len(ends) - 1, max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right"), "right") - 1))])
        for d, name, item_at, start, length in _longest(window[at:to], place[at:to], doc[at:to], items):
            out[d][1].append((items.names[name], int(item_at), int(start - begin[d]), int(length)))
        at = to
    return out


def _longest(window: np.ndarray, place: np.ndarray, doc: np.ndarray, items: Items) -> np.ndarray:
    """(document, item, first word in the item, place, words) of the longest match of each document and item
    (of equal ones the first in the document, then in the item)."""
    count = items.first[window + 1] - items.first[window]
    k = np.repeat(items.first[window], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, at = items.row[k], items.at[k]
    place, doc, length = np.repeat(place, count), np.repeat(doc, count), items.length[np.repeat(window, count)]
    order = np.lexsort((place, place - at, row))
    row, at, place, doc, length = row[order], at[order], place[order], doc[order], length[order]
    goes_on = (row[1:] == row[:-1]) & (np.diff(place) == 1) & (np.diff(at) == 1)
    first = np.flatnonzero(np.r_[True, ~goes_on])
    runs = np.diff(np.r_[first, len(row)])
    length = length[first] + runs - 1
    name, doc, at, place = items.name[row[first]], doc[first], at[first], place[first]
    best = np.lexsort((at, place, -length, name, doc))
    new = np.r_[True, (np.diff(doc[best]) != 0) | (np.diff(name[best]) != 0)]
    best = best[new]
    return np.stack([doc[best], name[best], at[best], place[best], length[best]], axis=1)


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of flattened spans."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


MATCHES = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def _pass(batches: Iterator[pa.RecordBatch], shared: Broadcast, block_words: int, field: int) -> Iterator[pa.RecordBatch]:
    """``field``: the place of the text among the columns of ``row``."""
    items: Items = shared.value
    for batch in batches:
        texts = batch.column("row").field(field)
        n_words: list[int] = []
        found: list[tuple[list[int], list[Match]]] = []
        block: list[list[bytes]] = []
        held = 0
        for k in range(batch.num_rows):
            block.append(tokens(texts[k].as_py()))
            n_words.append(len(block[-1]))
            held += len(block[-1])
            if held >= block_words or k == batch.num_rows - 1:
                found += search(block, items)
                block, held = [], 0
        spans = [merged(old, new) if old else new for old, (new, _) in zip(batch.column("spans").to_pylist(), found, strict=True)]
        named = [[dict(zip(("item", "item_start", "start", "length"), m, strict=True)) for m in new] for _, new in found]
        matches = [old + new if old else new for old, new in zip(batch.column("matches").to_pylist(), named, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(matches, MATCHES)],
            names=["row", "n_words", "spans", "matches"],
        )


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    item_bytes: int = ITEM_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (a struct of its columns, or of ``keep``),
    ``n_words``, ``n_hit`` (words inside any hit), ``spans`` (merged [start, end) word positions of all
    verbatim hits, flattened), ``matches`` (for each item with hits its id as a string and its longest
    verbatim match: first word in the item, first word in the document, words), ``items`` (their ids)
    and ``longest`` (words of the longest match).

    ``benchmark`` has item_id and text. A window is 13 consecutive words of an item; an
    item of fewer words is one window. Of equally long matches of an item the first in the document
    counts, then the first in the item. Items with no words or without an id are never
    found. Null and empty documents have no words; a very long document is one suffix array. Repeated
    rows each get a row, and repeated item ids are one item. Columns of ``docs`` may have any names.
    Empty tables give an empty result, or no hits.

    The benchmark's size is measured first. It is searched for in passes of about
    ``item_bytes`` of texts, each broadcast on its own; the test suite of today needs
    one. Documents are not shuffled, and each text goes to Python once a pass."""
    spark = docs.sparkSession
    sized = benchmark.filter("item_id is not null and text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // item_bytes))
    columns = docs.columns if keep is None else list(keep)
    carried = columns if text in columns else [*columns, text]
    now = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<struct<item: string, item_start: long, start: long, length: long>>").alias("matches"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in now.schema])
    field = carried.index(text)
    for k in range(passes):
        part = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).select(F.col("item_id").cast("string"), "text")
        items = prepare([(r[0], r[1]) for r in part.collect()])
        shared = spark.sparkContext.broadcast(items)
        now = now.mapInArrow(lambda batches, shared=shared: _pass(batches, shared, block_words, field), schema)
    lengths = F.transform("spans", lambda x, k: F.when(k % 2 == 1, x - F.get("spans", k - 1)).otherwise(F.lit(0)))
    return now.select(
        F.struct(*[F.col(f"row.`{c}`") for c in columns]).alias("row"),
        "n_words",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        "spans",
        "matches",
        F.transform("matches", lambda m: m["item"]).alias("items"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0).cast("long")).alias("longest"),
    )


#: At least one hit word, and hit words at least a twentieth of all.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, with its columns as they were."""
    return annotate(docs, benchmark, text).filter(f"not ({CONTAMINATED})").select("row.*")
