"""Two-class weak supervision: labelers vote 1, -1 or abstain with 0, and
expectation-maximisation finds how far each can be trusted.

The model sees only how often each combination of votes occurs. Spark counts
these over all rows; at most 3 to the power of the number of labelers come back,
whatever the size of the corpus."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

Votes = tuple[int, ...]


def by_negatives(pattern: Votes) -> float:
    """A first belief for rows that are mostly good: by the number of negative votes (0, 1, 2, or more)."""
    return (0.95, 0.6, 0.15, 0.05)[min(3, sum(v < 0 for v in pattern))]


def by_balance(pattern: Votes) -> float:
    """A first belief for mere candidates: by the sum of all votes."""
    balance = sum(pattern)
    return 0.9 if balance > 0 else 0.5 if balance == 0 else 0.1


def fit(
    counts: Mapping[Votes, float],
    negative: Mapping[Votes, float] | None = None,
    iterations: int = 1000,
    prior: float = 0.9,
    start: Callable[[Votes], float] = by_negatives,
    belief: tuple[float, float] = (0.5, 0.5),
    weight: float = 0.0,
    tolerance: float = 1e-9,
    most_false_alarms: float | None = None,
) -> dict[Votes, float]:
    """The posterior probability of the positive class for each vote pattern of ``counts``.

    A labeler has two error rates, ``P(-1 | positive)`` and ``P(-1 | negative)``, both given
    that it does not abstain; an abstention says nothing. The rates are free: they are what
    the weighted counts give, beside a prior ``belief`` in the two rates that counts as two votes and
    ``weight`` times the rows (a mixture of few labelers needs some: one that votes alone tells
    no class from another). ``negative`` counts the
    patterns of rows known to be negative: they anchor what the second class means, as their
    votes count towards its rates whatever expectation believes. The first expectation is
    ``start``; by default one negative vote alone decides nothing: if a labeler casts it alone
    on many rows that all others call good, its false alarms are learned and the rows stay positive. Iteration ends when no posterior moves by
    more than ``tolerance`` (``iterations`` bounds it where they creep). ``most_false_alarms``
    bounds ``P(-1 | positive)`` for callers who know it; by default nothing does. Without rows
    the result is empty."""
    patterns = sorted(p for p, n in counts.items() if n > 0)
    if not patterns:
        return {}
    known = {p: n for p, n in (negative or {}).items() if n > 0}
    post = {p: start(p) for p in patterns}
    total = float(sum(counts[p] for p in patterns))
    for _ in range(iterations):
        positive = sum(counts[p] * post[p] for p in patterns)
        share = (positive + prior) / (total + 1)
        odds = [_odds(patterns, counts, post, known, j, belief, 2 + weight * total, most_false_alarms) for j in range(len(patterns[0]))]
        moved = 0.0
        for p in patterns:
            x = math.log(share / (1 - share)) + sum(odds[j][v] for j, v in enumerate(p) if v)
            new = 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))
            moved = max(moved, abs(new - post[p]))
            post[p] = new
        if moved < tolerance:
            break
    return post


def _odds(patterns: list[Votes], counts: Mapping[Votes, float], post: Mapping[Votes, float], known: Mapping[Votes, float], j: int, belief: tuple[float, float], weight: float, most: float | None) -> dict[int, float]:
    """The log odds that a vote of labeler ``j`` adds, for -1 and 1."""
    told = [p for p in patterns if p[j]]
    good, good_no = sum(counts[p] * post[p] for p in told), sum(counts[p] * post[p] for p in told if p[j] < 0)
    bad, bad_no = sum(counts[p] * (1 - post[p]) for p in told), sum(counts[p] * (1 - post[p]) for p in told if p[j] < 0)
    bad += sum(n for p, n in known.items() if p[j])
    bad_no += sum(n for p, n in known.items() if p[j] < 0)
    alarms, caught = (good_no + weight * belief[0]) / (good + weight), (bad_no + weight * belief[1]) / (bad + weight)
    if most is not None:
        alarms = min(most, alarms)
    caught = max(alarms, caught)  # a labeler may be useless but is never believed to mean the opposite
    return {-1: math.log(alarms / caught), 1: math.log((1 - alarms) / (1 - caught))}
