"""The analyser of full-text search as DuckDB SQL: Porter's steps as regular expressions over a vocabulary.

It shares the suffix tables with :mod:`quillgraph.functions.stem`, not the way of working: measures are patterns here,
vowel-consonant shapes there."""

from __future__ import annotations

from collections.abc import Callable

from quillgraph.functions.stem import STEP2, STEP3, STEP4

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
MORE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
VOWEL, SHORT = f"^({CONSONANTS})?[aeiouy]", f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
#: y is a consonant after a vowel, and at the beginning, where it is written Y.
ENDS_SHORT = "([^aeiouy]|[aeiou]y)[aeiouy][^aeiouwxy]$"

has = lambda s, pattern: f"regexp_matches({s}, '{pattern}')"
cut = lambda n: f"left(w, length(w) - {n})"


def _suffixes(table: dict[str, str], body: Callable[[str, str], str]) -> str:
    ordered = sorted(table, key=len, reverse=True)
    return "case " + " ".join(f"when ends_with(w, '{s}') then {body(s, table[s])}" for s in ordered) + " else w end"


def stems(tokens: str, name: str) -> str:
    """CTEs from ``tokens`` (t), distinct lower-case words, to ``name`` (t, w), their terms; empty ones go."""
    changed = lambda s, to: f"case when {has(cut(len(s)), SOME)} then {cut(len(s))} || '{to}' else w end"
    dropped = lambda s, _: f"case when {has(cut(len(s)), MORE)}" + (f" and {has(cut(3), '[st]$')}" if s == "ion" else "") + f" then {cut(len(s))} else w end"
    after = f"case when {has('w', '(at|bl|iz)$')} then w || 'e' when right(w, 1) = substr(w, length(w) - 1, 1) and length(w) > 1 and {has('w', '([^aeiouylsz]|[^aeiouy]yy)$')} then {cut(1)} when {has('w', SHORT)} then w || 'e' else w end"
    steps = [
        "case when regexp_matches(w, '(sses|ies)$') then left(w, length(w) - 2) when ends_with(w, 's') and not ends_with(w, 'ss') then left(w, length(w) - 1) else w end",
        f"case when ends_with(w, 'eed') then case when {has(cut(3), SOME)} then {cut(1)} else w end when ends_with(w, 'ed') and {has(cut(2), VOWEL)} then chr(1) || {cut(2)} when ends_with(w, 'ing') and {has(cut(3), VOWEL)} then chr(1) || {cut(3)} else w end",
        f"list_transform([w], lambda m: case when starts_with(m, chr(1)) then list_transform([m[2:]], lambda w: {after})[1] else m end)[1]",
        f"case when ends_with(w, 'y') and {has(cut(1), VOWEL)} then {cut(1)} || 'i' else w end",
        _suffixes(STEP2, changed),
        _suffixes(STEP3, changed),
        _suffixes({s: "" for s in [*STEP4, "ion"]}, dropped),
        f"case when ends_with(w, 'e') and ({has(cut(1), MORE)} or ({has(cut(1), ONE)} and not {has(cut(1), ENDS_SHORT)})) then {cut(1)} else w end",
        f"case when ends_with(w, 'll') and {has(cut(1), MORE)} then {cut(1)} else w end",
    ]
    out = f"{name}0 as (select distinct t, strip_accents(t) a from {tokens}),\n {name}s0 as materialized (select t, a, case when starts_with(a, 'y') then 'Y' || a[2:] else a end w from {name}0 where length(a) > 2 and regexp_full_match(a, '[a-z]+'))"
    for k, step in enumerate(steps):
        out += f",\n {name}s{k + 1} as materialized (select t, a, {step} w from {name}s{k})"
    return out + f",\n {name} as materialized (select t, lower(w) w from {name}s{len(steps)} union all select t, a from {name}0 where not (length(a) > 2 and regexp_full_match(a, '[a-z]+')) and a <> '')"
