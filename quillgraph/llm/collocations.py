"""Operator 11: collocations from count streams in prefix and suffix order.

Two passes over the texts count phrases of one and two words, then of three and four. The second looks only at
phrases whose word pairs are all frequent, as a Bloom filter of a fixed size tells: a pair that it lets through by
mistake costs a few rows, for all counts are exact. What remains are the frequent phrases, at most four for every
``least`` words of the corpus. These are the count streams. Every cut of a phrase is merged with the stream sorted
by first parts (prefix order), then with the stream sorted by last parts (suffix order), and the
longer phrases, each under its head and its tail, are merged with the phrases: sort-merge joins, which read both
sides in step and build no hash table, so neither side needs to fit in memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm._spark import by_value, checkpoint

by_value(__name__)
MOST_WORDS = 4
#: Where texts end a piece, and what stands between words.
PIECES, BLANKS = "[.,;:!?\n\x0b\x0c\r]", "[ \t]+"
#: The language of a null.
UNKNOWN = "und"
#: Bytes of text that a task counts at a time, and rows of a batch that it hands on.
SLICE, ROWS = 2 << 20, 1 << 16
#: Bits of the filter of frequent pairs (16 MB), and those of one of its parts.
FILTER_BITS, PART_BITS = 1 << 27, 1 << 17
COUNTS = "lang string, phrase string, words int, f long"


class Counted:
    """The words of some texts as numbers, and the phrases that begin at each.

    ``code`` numbers (language, word) pairs; ``at`` has the places where a phrase of ``words`` words begins, ``ids`` its
    number, ``phrases`` and ``langs`` the text and the language of each number."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), PIECES)
        row = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
        split = pc.split_pattern_regex(pieces.flatten(), BLANKS)
        flat, piece = split.flatten(), pc.list_parent_indices(split)
        full = pc.not_equal(flat, "")
        flat, self.piece = flat.filter(full).dictionary_encode(), piece.filter(full).to_numpy(zero_copy_only=False)
        kinds = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        word, size = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary)
        of = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[self.piece]] if len(word) else word
        code, found = pd.factorize(of * size + word)
        self.code, self.words = code.astype(np.int64), 1
        self.vocabulary = self.phrases = flat.dictionary.take(pa.array(found % max(size, 1)))
        self.langs = kinds.dictionary.take(pa.array(found // max(size, 1)))
        self.at, self.ids = np.arange(len(code)), self.code

    def longer(self, good: np.ndarray | None = None) -> None:
        """On to phrases of one word more; ``good``: for each place, whether the pair that begins there may be part of one."""
        end = self.at + self.words
        on = end < len(self.code)
        on[on] = self.piece[end[on]] == self.piece[self.at[on]]
        if good is not None:
            on[on] = good[end[on] - 1] & good[self.at[on]]
        size = len(self.vocabulary)
        ids, found = pd.factorize(self.ids[on] * size + self.code[end[on]])
        head, last = pa.array(found // max(size, 1)), pa.array(found % max(size, 1))
        self.phrases = pc.binary_join_element_wise(self.phrases.take(head), self.vocabulary.take(last), " ")
        self.langs, self.at, self.ids = self.langs.take(head), self.at[on], ids.astype(np.int64)
        self.words += 1

    def counts(self) -> Iterator[pa.RecordBatch]:
        n = pa.array(np.bincount(self.ids, minlength=len(self.phrases)).astype(np.int64))
        whole = pa.Table.from_arrays([self.langs, self.phrases, pa.array(np.full(len(n), self.words, np.int32)), n], names=["lang", "phrase", "words", "f"])
        yield from whole.to_batches(max_chunksize=ROWS)

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language, as the count of the empty phrase."""
        per = pa.table({"lang": self.langs.take(pa.array(self.ids))}).group_by("lang").aggregate([([], "count_all")])
        n = len(per)
        return pa.RecordBatch.from_arrays([per["lang"].combine_chunks(), pa.array([""] * n, pa.string()), pa.array([0] * n, pa.int32()), per["count_all"].combine_chunks().cast(pa.int64())], names=["lang", "phrase", "words", "f"])

    def pair_hashes(self) -> np.ndarray:
        """The hash of the pair that begins at each place but the last; ends of pieces are not looked at."""
        h = word_hashes(self.langs, self.vocabulary)[self.code]
        return pair_hash(h[:-1], h[1:])


def word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    of = lambda xs: pd.util.hash_array(np.array(xs.to_pylist(), dtype=object), categorize=False).astype(np.uint64) if len(xs) else np.zeros(0, np.uint64)
    return of(words) + of(langs) * np.uint64(31)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def filter_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x85EBCA6B) % np.uint64(bits)


def _parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end where a piece does; counts add up to the whole text's."""
    ends, start = re.compile(PIECES), 0
    while start < len(text):
        end = ends.search(text, start + size)
        stop = end.end() if end else len(text)
        yield text[start:stop]
        start = stop


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) of about SLICE bytes; a longer text is cut between pieces."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        if size[start] > SLICE:
            for part in _parts(batch.column("text")[start].as_py(), SLICE // 4):
                yield pa.RecordBatch.from_arrays([pa.array([part]), batch.column("lang").slice(start, 1)], names=["text", "lang"])
        else:
            yield batch.slice(start, stop - start)
        start = stop


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the empty phrase, of words and of pairs."""
    for batch in batches:
        for part in _slices(batch):
            c = Counted(part.column("text"), part.column("lang"))
            yield c.totals()
            yield from c.counts()
            c.longer()
            yield from c.counts()
        pa.default_memory_pool().release_unused()


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = pc.split_pattern(batch.column("phrase"), " ").flatten()
        first, second = pairs.take(pa.array(np.arange(0, len(pairs), 2))), pairs.take(pa.array(np.arange(1, len(pairs), 2)))
        langs = batch.column("lang")
        bits = np.unique(np.concatenate(filter_bits(pair_hash(word_hashes(langs, first), word_hashes(langs, second)), FILTER_BITS))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((bits // PART_BITS).astype(np.int32)), pa.array((bits % PART_BITS).astype(np.int32))], names=["part", "bit"])


def _part(key: tuple, rows: pa.Table) -> pa.Table:
    held = np.zeros(PART_BITS, bool)
    held[rows.column("bit").to_numpy()] = True
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """The bits of (lang, phrase) of two words, eight to a byte: FILTER_BITS / 8 bytes, whatever the number of pairs.

    Each part of the filter is made in a task of its own from at most PART_BITS distinct bits."""
    bits = pairs.select("lang", "phrase").mapInArrow(_bits, "part int, bit int").distinct()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = PART_BITS // 8
    for r in bits.groupBy("part").applyInArrow(_part, "part int, bits binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent(docs: DataFrame, lang_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of phrases of one to four words with f >= least, (lang, n))."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    summed = lambda counts: counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    short = checkpoint(summed(texts.mapInArrow(_short, COUNTS)).filter((F.col("words") == 0) | (F.col("f") >= least)))
    held = docs.sparkSession.sparkContext.broadcast(pair_filter(short.filter("words = 2")))

    def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of phrases of three and four words whose pairs may be frequent."""
        has = lambda b: (held.value[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7))).astype(np.uint8)) & np.uint8(1)
        for batch in batches:
            for part in _slices(batch):
                c = Counted(part.column("text"), part.column("lang"))
                one, two = filter_bits(c.pair_hashes(), FILTER_BITS)
                good = (has(one) & has(two)).astype(bool)
                c.longer(good)
                for _ in range(MOST_WORDS - 2):
                    c.longer(good)
                    yield from c.counts()
            pa.default_memory_pool().release_unused()

    long = checkpoint(summed(texts.mapInArrow(_long, COUNTS)).filter(F.col("f") >= least))
    return short.filter("words > 0").unionByName(long), short.filter("words = 0").select("lang", F.col("f").alias("n"))


def _part_of(words: Column) -> Column:
    """The first ``words`` words of the phrase, or the last ones for a negative number."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), words)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    Texts in lower case (A-Z alone) are split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words;
    a null language is ``und``. A phrase counts wherever it stands within a piece, overlaps included. Of a phrase with
    a = f >= least, a cut into two parts of counts l and r scores floor(2000000 * a / (l + r)); the lowest cut counts, the
    first of equal ones. A phrase goes if one word more before or after it keeps ``share`` hundredths of its occurrences
    (a phrase inside a longer one is then also inside one longer by one word that is at least as frequent, so
    that no longer ones need be looked at). Ranks go by score, then a, both descending, then by the phrase's
    bytes. Numbers are 38-digit decimals where products may pass 64 bits. Null, empty and word-less texts
    count nothing; repeated rows count as often as they stand; an empty table gives an empty result. Other columns are not
    read, whatever their names. A hot language or phrase is pre-counted in each task; a text longer than SLICE
    is counted in parts that end where pieces do, whole if it has no such end."""
    phrases, totals = frequent(docs, lang_col, text_col, least)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    found = phrases.filter("words > 1")
    cuts = found.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part_of(F.col("k")).alias("head"), _part_of(F.col("k") - F.col("words")).alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = lambda n: found.filter("words > 2").select("lang", _part_of(n).alias("phrase"), "f")
    longer = inner(F.col("words") - 1).unionByName(inner(1 - F.col("words"))).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = lowest.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (big("longest") * 100 < big("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
