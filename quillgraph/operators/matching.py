"""In-task matching of clauses and phrases (K6): what is asked goes to each task once, documents stay where they are.

A task looks up the asked words in its documents' own lists; a clause is tried only in documents that hold the rarest of its
words, and places are compared only where all of them stand. Nothing is shuffled but the hits."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
#: Cells (clauses or queries times documents) and meetings of words and clauses that a task looks at at a time.
CELLS, PAIRS = 1 << 24, 1 << 20
#: Places are smaller than this, fields included.
PLACES = 1 << 32
KINDS = ("all", "phrase", "near", "prefix")


def _starts(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n)]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): each ``at`` from first[i] on, n[i] times, and its i."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(_starts(n)[:-1], n) + np.repeat(first, n)


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows that hold about PAIRS of what ``n`` counts, one row at least."""
    upto = np.cumsum(n)
    cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(upto) else 0, PAIRS)) + 1, len(n)])
    return (slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True))


@dataclass(frozen=True)
class Asked:
    """Distinct clauses over words and prefixes as numbers, and the classes of queries as lists of clauses by role.

    Clauses of kind prefix have codes of ``prefixes``, others of ``words``; clause c has ``codes[ends[c]:ends[c + 1]]``.
    ``anchors``: clauses by the code of their rarest word, ``anchors[by[w]:by[w + 1]]``, and ``offset``, its place within the clause."""

    names: pa.Array
    words: pa.Array
    prefixes: pa.Array
    kind: np.ndarray
    field: np.ndarray
    gap: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    anchors: np.ndarray
    by: np.ndarray
    offset: np.ndarray
    roles: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def asked(rows: list[tuple], df: dict[str, int], kind: pa.DataType) -> Asked:
    """``rows`` (q, role, kind, terms, field, gap) of the queries' clauses; ``df``: how many documents hold a word."""
    number: dict[object, int] = {}
    clauses: dict[tuple, int] = {}
    held: dict[str, set[tuple[int, int]]] = {"must": set(), "should": set(), "never": set()}
    for q, role, k, terms, field, gap in rows:
        terms = tuple(terms) if k == "phrase" else tuple(dict.fromkeys(terms))
        clause = clauses.setdefault((KINDS.index(k), terms, -1 if field is None else field, gap if k == "near" else 0), len(clauses))
        held[role].add((number.setdefault(q, len(number)), clause))
    words = {w: i for i, w in enumerate(sorted({w for c in clauses if c[0] < 3 for w in c[1]}))}
    prefixes = {w: i for i, w in enumerate(sorted({w for c in clauses if c[0] == 3 for w in c[1]}))}
    codes = [np.array([(prefixes if c[0] == 3 else words)[w] for w in c[1]], np.int64) for c in clauses]
    rare = [(min(range(len(c[1])), key=lambda i: df.get(c[1][i], 0)) if c[1] else -1) if c[0] < 3 else -1 for c in clauses]  # noqa: B023
    rooted = [i for i, at in enumerate(rare) if at >= 0]
    root = np.array([codes[i][rare[i]] for i in rooted], np.int64)
    order = np.argsort(root, kind="stable")
    roles = {}
    for role, pairs in held.items():
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        of, first = np.unique(both[:, 0], return_index=True)
        roles[role] = (of, both[:, 1], first)
    column = lambda i: np.array([c[i] for c in clauses], np.int64)
    return Asked(
        pa.array(list(number), kind), pa.array(list(words), pa.string()), pa.array(list(prefixes), pa.string()), column(0), column(2), column(3),
        np.concatenate([*codes, np.zeros(0, np.int64)]), _starts(np.array([len(c) for c in codes], np.int64)),
        np.array(rooted, np.int64)[order], _starts(np.bincount(root, minlength=len(words))), np.array(rare, np.int64), roles,
    )


class _Held:
    """The postings of a batch whose words are asked, in order of row and word, with their places."""

    def __init__(self, row: np.ndarray, code: np.ndarray, first: np.ndarray, n: np.ndarray, places: np.ndarray, words: int) -> None:
        order = np.argsort(row * words + code, kind="stable")
        self.words, self.row, self.code, self.n = words, row[order], code[order], n[order]
        self.key = self.row * words + self.code
        which, at = _spread(first[order], self.n)
        self.place, self.first = which * PLACES + places[at], _starts(self.n)[:-1]

    def find(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of postings, and whether they are there."""
        at = np.minimum(np.searchsorted(self.key, row * self.words + code), max(0, len(self.key) - 1))
        return at, self.key[at] == row * self.words + code

    def following(self, posting: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of a posting from ``place`` on; PLACES if there is none."""
        at = np.searchsorted(self.place, posting * PLACES + place)
        there = at < self.first[posting] + self.n[posting]
        return np.where(there, self.place[np.minimum(at, len(self.place) - 1)] - posting * PLACES, PLACES)

    def places(self, posting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which, at = _spread(self.first[posting], self.n[posting])
        return which, self.place[at] - posting[which] * PLACES


def _true(a: Asked, held: _Held, clause: np.ndarray, posting: np.ndarray, wide: int) -> np.ndarray:
    """Which clauses hold in the documents of the postings of their rarest words; a field is ``wide`` places."""
    row, n, alive = held.row[posting], np.diff(a.ends)[clause], np.arange(len(clause))
    found = np.zeros((int(n.max(initial=0)), len(clause)), np.int64) if n.max(initial=0) <= 8 else None

    def word(i: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        if found is not None and known[j]:
            return found[j, i], np.ones(len(i), bool)
        return held.find(row[i], a.codes[a.ends[clause[i]] + j])

    known = np.zeros(int(n.max(initial=0)), bool)
    for j in range(int(n.max(initial=0))):  # all words are there
        i = alive[n[alive] > j]
        at, there = word(i, j)
        if found is not None:
            found[j, i], known[j] = at, True
        alive = np.setdiff1d(alive, i[~there], assume_unique=True)
    field, gap, kind = a.field[clause], a.gap[clause], a.kind[clause]
    low = np.where(field < 0, 0, field * wide)
    high = np.where(field < 0, PLACES - 1, (field + 1) * wide - 1)
    out = [alive[(kind[alive] == 0) & (field[alive] < 0)]]
    i = alive[(kind[alive] == 0) & (field[alive] >= 0)]
    ok = np.ones(len(i), bool)
    for j in range(int(n[i].max(initial=0))):
        on = np.flatnonzero(n[i] > j)
        ok[on] &= held.following(word(i[on], j)[0], low[i[on]]) <= high[i[on]]
    out.append(i[ok])
    for part in _parts(held.n[posting[(i := alive[kind[alive] == 1])]]):  # a phrase begins so far before its rarest word
        which, place = held.places(posting[i[part]])
        of, start = i[part][which], place - a.offset[clause[i[part][which]]]
        on = np.flatnonzero((start >= low[of]) & (start <= high[of]))
        for j in range(int(n[of[on]].max(initial=0))):
            longer = n[of[on]] > j
            some = on[longer]
            stands = held.following(word(of[some], j)[0], start[some] + j) == start[some] + j
            on = np.r_[on[~longer], some[stands]]
        out.append(np.unique(of[on]))
    i = alive[kind[alive] == 2]
    for u in range(int(n[i].max(initial=0))):  # a stretch begins at one of its words
        some = i[n[i] > u]
        first = word(some, u)[0]
        for part in _parts(held.n[first]):
            which, start = held.places(first[part])
            of = some[part][which]
            on = np.flatnonzero((start >= low[of]) & (start <= high[of]))
            for v in range(int(n[of[on]].max(initial=0))):
                longer = n[of[on]] > v
                rest = on[longer]
                last = held.following(word(of[rest], v)[0], start[rest])
                on = np.r_[on[~longer], rest[(last - start[rest] <= gap[of[rest]] + 1) & (last <= high[of[rest]])]]
            out.append(np.unique(of[on]))
    return np.concatenate(out)


def _begun(a: Asked, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(word, prefix): the words of a batch's vocabulary and the asked prefixes that they begin with."""
    vocabulary, words, prefixes = coded.dictionary, [], []
    own = pc.utf8_length(a.prefixes).to_numpy(zero_copy_only=False)
    for size in np.unique(own):
        of = np.flatnonzero(own == size)
        cut = pc.utf8_slice_codeunits(vocabulary, 0, int(size)) if size else pa.array([""] * len(vocabulary))
        code = pc.fill_null(pc.index_in(cut, value_set=a.prefixes.take(pa.array(of))), -1).to_numpy(zero_copy_only=False)
        words.append(np.flatnonzero(code >= 0))
        prefixes.append(of[code[code >= 0]])
    return np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*prefixes, np.zeros(0, np.int64)])


def matcher(shared: object, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (id, terms, positions): (q, id) of the classes of queries of the broadcast fields of an :class:`Asked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Asked(**shared.value)
        several = len(a.kind)
        size = max(1, CELLS // max(1, several + sum(len(c) for _, c, _ in a.roles.values())))
        for batch in batches:
            lists = batch.column("terms")
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            word = coded.indices.to_numpy(zero_copy_only=False)
            stands = batch.column("positions").flatten()
            n = pc.list_value_length(stands).to_numpy(zero_copy_only=False).astype(np.int64)
            places = stands.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(coded.dictionary, value_set=a.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
            first, on = _starts(n)[:-1], code >= 0
            held = _Held(row[on], code[on], first[on], n[on], places, max(1, len(a.words)))
            begins, prefix = _begun(a, coded)
            order = np.argsort(begins, kind="stable")
            many = np.bincount(begins, minlength=len(coded.dictionary)) if len(begins) else np.zeros(len(coded.dictionary), np.int64)
            which, at = _spread(_starts(many)[:-1][word], many[word])
            begun, fields = prefix[order][at], {f: None for f in np.unique(a.field[a.kind == 3])}
            for f in fields:  # which postings stand in a field
                fields[f] = np.ones(len(word), bool) if f < 0 or not len(word) else np.logical_or.reduceat(places // wide == f, first)
            for top in range(0, batch.num_rows if several else 0, size):
                rows = min(size, batch.num_rows - top)
                there = np.zeros((several, rows), bool)
                i, j = np.searchsorted(held.row, [top, top + rows])
                tried = np.diff(a.by)[held.code[i:j]]
                for part in _parts(tried):
                    posting, clause = _spread(a.by[held.code[i:j][part]], tried[part])
                    posting, clause = posting + i + part.start, a.anchors[clause]
                    true = _true(a, held, clause, posting, wide)
                    there[clause[true], held.row[posting[true]] - top] = True
                i, j = np.searchsorted(row[which], [top, top + rows])
                for f, inside in fields.items():
                    has = np.zeros((len(a.prefixes), rows), bool)
                    on = inside[which[i:j]]
                    has[begun[i:j][on], row[which[i:j]][on] - top] = True
                    for c in np.flatnonzero((a.kind == 3) & (a.field == f) & (np.diff(a.ends) > 0)):
                        there[c] = has[a.codes[a.ends[c] : a.ends[c + 1]]].all(axis=0)
                out = np.zeros((len(a.names), rows), bool)
                for role in ("should", "must", "never"):
                    of, clause, begin = a.roles[role]
                    if len(of) and role == "should":
                        out[of] = np.logical_or.reduceat(there[clause], begin, axis=0)
                    elif len(of) and role == "must":
                        met = np.logical_and.reduceat(there[clause], begin, axis=0)
                        alone = np.isin(of, a.roles["should"][0], invert=True)
                        out[of] = met & (out[of] | alone[:, None])
                    elif len(of):
                        out[of] &= ~np.logical_or.reduceat(there[clause], begin, axis=0)
                q, doc = np.nonzero(out)
                if len(q):
                    yield pa.RecordBatch.from_arrays([a.names.take(pa.array(q)), batch.column("id").slice(top).take(pa.array(doc))], names=["q", "id"])

    return run


#: Tokens of documents that a task looks at at a time (one document at least).
TOKENS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For 1, 2, 4, ... words: a hash of the words from each place on."""
    h, width = _mixed(codes.astype(np.int64).astype(np.uint64) + np.uint64(2)), 1
    while len(h):
        yield h
        h, width = _mixed(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]), 2 * width


def phrase_table(names: pa.Array, terms: pa.ListArray) -> dict[str, object]:
    """Phrases as numbers of words. By the largest power of two up to their lengths: the phrases in order of the hash of so many
    first words, that hash and that of so many last words."""
    coded = terms.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    start, level = _starts(n)[:-1], np.log2(np.maximum(n, 1)).astype(np.int64)
    levels = {}
    for j, h in zip(range(int(level.max(initial=-1)) + 1), _hashes(codes), strict=False):
        of = np.flatnonzero((level == j) & (n > 0))
        of = of[np.argsort(h[start[of]], kind="stable")]
        if len(of):
            levels[j] = (of, h[start[of]], h[start[of] + n[of] - (1 << j)])
    return {"names": names, "words": coded.dictionary, "codes": codes, "start": start, "n": n, "levels": levels}


def _phrases_in(t: dict[str, object], codes: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, phrase) of all occurrences; ``end``: where the document of each place ends."""
    for j, h in enumerate(_hashes(codes)):
        if j > max(t["levels"], default=-1):
            return
        if j not in t["levels"]:
            continue
        of, first, last = t["levels"][j]
        likely = np.zeros(1 << 20, bool)
        likely[first >> np.uint64(44)] = True
        at = np.flatnonzero(likely[h >> np.uint64(44)])
        low = np.searchsorted(first, h[at])
        many = np.searchsorted(first, h[at], "right") - low
        for part in _parts(many):
            which, phrase = _spread(low[part], many[part])
            place, n = at[part][which], t["n"][of[phrase]]
            on = np.flatnonzero(place + n <= end[place])
            on = on[h[place[on] + n[on] - (1 << j)] == last[phrase[on]]]
            place, phrase, n = place[on], of[phrase[on]], n[on]
            for some in _parts(n):  # word by word, as hashes may meet by chance
                k, here = _spread(place[some], n[some])
                same = codes[here] == t["codes"][here - place[some][k] + t["start"][phrase[some]][k]]
                ok = np.logical_and.reduceat(same, _starts(n[some])[:-1])
                yield place[some][ok], phrase[some][ok]


def phrase_counter(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (id, terms): (q, id, n) of the phrases of a broadcast :func:`phrase_table`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        many = max(1, len(t["names"]))
        for batch in batches:
            length = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, top = np.cumsum(length), 0
            while top < batch.num_rows:
                stop = max(top + 1, int(np.searchsorted(upto, (upto[top - 1] if top else 0) + TOKENS, "right")))
                part, n, top = batch.slice(top, stop - top), length[top:stop], stop
                coded = part.column("terms").flatten().dictionary_encode()
                code = pc.fill_null(pc.index_in(coded.dictionary, value_set=t["words"]), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                found = [row[place] * many + phrase for place, phrase in _phrases_in(t, code[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(n)[row])]
                key, times = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
                if len(key):
                    yield pa.RecordBatch.from_arrays([t["names"].take(pa.array(key % many)), part.column("id").take(pa.array(key // many)), pa.array(times.astype(np.int64))], names=["q", "id", "n"])

    return run
