"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    worth = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
    return sum(worth) % 10 == 0


def pii(text: str | None) -> list[str]:
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def fingerprint(text: str | None) -> int:
    w = SPACED.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def classes(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    prints = {i: fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    bits = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(bits[a] ^ bits[a + 1 :]) <= 4):
            x, y = find(a), find(a + 1 + int(b))
            root[max(x, y)] = min(x, y)
    return {ids[a]: (format(prints[ids[a]], "016x"), ids[find(a)]) for a in range(len(ids))}


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str], bool]:
    w = PLAIN.findall((text or "").translate(LOWER))
    where = defaultdict(list)
    hit, found = set(), set()
    for n in {min(13, len(PLAIN.findall((t or "").translate(LOWER)))) for _, t in items} - {0}:
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].append(k)
    for name, t in items:
        v = PLAIN.findall((t or "").translate(LOWER))
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in where.get(tuple(v[k : k + n]), ()):
                hit.update(range(p, p + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    w = SPACED.findall(t)
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    hit = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(8)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def rule_votes(text: str | None) -> tuple[int, ...]:
    """The quality rules' votes, from a plain reading of the text."""
    from quillgraph.llm.quality import COMMON

    t = text or ""
    n, chars, symbols, dup, repeat, _ = counts(t)
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    n1, l1, c1 = max(1, n), max(1, len(lines)), max(1, chars)
    rule = lambda v, good, bad: 0 if n < 5 else -1 if v > bad else 1 if v <= good else 0
    common = sum(x.translate(LOWER) in set(COMMON) for x in w)
    bare = sum(not any(c.isalpha() for c in x) for x in w)
    ended = sum(x.rstrip(" \t\x0b\x0c\r\"')]»”’")[-1:] in (".", "!", "?") for x in lines) / l1
    length = chars / n1
    return (
        -1 if n < 50 else 1 if n >= 100 else 0,
        0 if n < 1 else -1 if length < 3 or length > 10 else 1 if 3.5 <= length <= 7 else 0,
        rule(symbols / n1, 0.02, 0.1),
        rule(dup / l1, 0.15, 0.5),
        rule(repeat / n1, 0.1, 0.3),
        rule(bare / n1, 0.1, 0.2),
        0 if n < 20 else -1 if common < 2 or common / n1 < 0.02 else 1 if common / n1 >= 0.06 else 0,
        0 if n < 1 else -1 if ended < 0.5 else 1 if ended >= 0.9 else 0,
        rule(sum(unicodedata.category(c) == "Lu" for c in t) / c1, 0.1, 0.3),
        rule(sum(c in "!?" for c in t) / n1, 0.05, 0.2),
        rule(sum(c in "0123456789" for c in t) / c1, 0.05, 0.2),
    )


def em(votes: np.ndarray, bad: np.ndarray, rounds: int = 1000, prior: float = 0.9, balance: bool = False, belief: tuple[float, float] = (0.5, 0.5), weight: float = 2.0) -> np.ndarray:
    """The posterior of every row (rows that are known to be bad: of no meaning), row by row, without pattern counts."""
    free = votes[~bad]
    post = np.array([0.95, 0.6, 0.15, 0.05])[np.minimum((free < 0).sum(1), 3)]
    if balance:
        post = np.array([0.1, 0.5, 0.9])[np.sign(free.sum(1)) + 1]
    for _ in range(rounds):
        odds = np.full(len(free), np.log((post.sum() + prior) / (len(free) - post.sum() + 1 - prior)))
        for j in range(votes.shape[1]):
            no, told, anchor = free[:, j] < 0, free[:, j] != 0, votes[bad, j]
            alarms = (post[no].sum() + weight * belief[0]) / (post[told].sum() + weight)
            caught = ((1 - post)[no].sum() + (anchor < 0).sum() + weight * belief[1]) / ((1 - post)[told].sum() + (anchor != 0).sum() + weight)
            caught = max(alarms, caught)
            odds += np.where(no, np.log(alarms / caught), np.where(told, np.log((1 - alarms) / (1 - caught)), 0.0))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        still, post = np.abs(new - post).max() < 1e-9, new
        if still:
            break
    out = np.zeros(len(votes))
    out[~bad] = post
    return out
