"""Personal data by weak supervision.

Candidates are the spans of four base patterns, which always count, and of looser forms
(obfuscated e-mails, phone numbers without a plus, IPv6, card numbers that miss their check
digit) and further kinds (keys, passwords and tokens, IBANs, titled names, street addresses).
A regex labeler, a gazetteer labeler and a context labeler vote on each; expectation-
maximisation over the counts of vote patterns estimates how far they can be trusted, and its
posteriors are the labels that train a naive Bayes classifier over the form, votes and shape
of a span, which decides on the looser candidates. Everything is DataFrame functions: the
texts are read once and never leave their task."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import weak
from quillgraph.llm._spark import checkpoint, let

#: The kinds that have base patterns, and those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "name", "address", "secret")

#: The base patterns. Where nothing that a repetition matches can also follow it,
#: it is possessive, and a match may only begin where the one before ended or where the run of
#: its first class begins; both leave the matches as they are and bound the work on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"

#: Looser forms. Each part is bounded, so a failed attempt costs a bounded number of steps.
EMAIL_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])"
IP_SIX = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
CARD_GROUPS = r"(?<![0-9])(?<![0-9][ -])[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -]?[0-9])"
PHONE_LOCAL = r"(?<![0-9+])(?<![0-9+][ .(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])"
PHONE_ZEROS = r"(?<![0-9+])(?<![0-9][ .-])00[1-9][0-9]{0,2}[ .-](?:[0-9]{1,5}[ .-]){1,5}[0-9]{2,6}(?![ .-]?[0-9])"
#: A run that may be a key, and a value given to a name that promises a secret.
SECRET_RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}"
SECRET_SET = r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"']{6,128}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})?"
STREET = r"(?<![0-9])[0-9]{1,5} (?:\p{Lu}\p{L}{1,30} ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?![\p{L}])"

#: Fixed values of the gazetteer and context labelers.
ENDINGS = "com net org edu gov mil int info biz io dev app ai co uk de fr es it nl be ch at pl pt se no dk fi ie eu us ca mx br ar cl in cn jp kr au nz za ru ua tr".split()
NOT_HOSTS = r"^(?:0|127|255)\.|^(?:22[4-9]|2[3-5][0-9])\."
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9]))"
KEY_PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|pk_|rk_|xox[abprs]-|AIza|eyJ|glpat-|npm_|hf_)"
KEY_NAMES = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
#: Names of numbers that look like keys and are public.
HASH_NAMES = r"(?:commit|revision|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|guid|hash|integrity|build)[^a-z0-9]{0,4}$"
GIVEN_NAMES = "james mary john robert michael david william richard thomas charles daniel paul mark peter anna maria elizabeth susan sarah karen laura julia emma hans klaus jürgen wolfgang petra sabine monika jean pierre michel marie sophie claire jose juan carlos luis antonio carmen ana".split()
TITLE_WORDS = "president speaker chairman minister secretary professor doctor who what and the jekyll holmes".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CODES = r"^(?:00)?(?:1[2-9]|7|2[0-9]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS_FOR = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|address|courriel|correo)\b",
    "ip": r"\b(?:ip|ipv4|ipv6|host|server|address|from|client|login|adresse)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pay|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|tél|teléfono)\b",
    "secret": r"[=:][ ]?[\"']?$",
    "iban": r"\b(?:iban|account|konto|compte|cuenta|bank|transfer)\b",
    "name": r"\b(?:dear|contact|attn|signed|by|from|with|name|patient|client)\b",
    "address": r"\b(?:address|live|lives|living|at|to|office|home|visit|ship)\b",
}
WORDS_AGAINST = r"\b(?:isbn|issn|doi|order|invoice|version|ver|v|page|section|figure|table|chapter|ticket|serial|sku|nr)[ .:#]{0,3}$"


#: Spans of the kind's own mixture that count towards each class's share of a feature value.
STRENGTH = 5.0
#: The prior belief in a labeler of spans: how often it says no to personal data, and to other spans.
BELIEF = (0.1, 0.6)


@dataclass(frozen=True)
class Form:
    """A pattern of candidates; a text with none of ``needs`` has none of them (empty: look at all)."""

    kind: str
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    needs: tuple[str, ...]
    base: bool


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    d = F.split(F.reverse(digits(m)), "")
    worth = F.transform(d, lambda x, i: F.when(x == "", 0).when(i % 2 == 0, F.try_to_number(x, F.lit("9")).cast("int")).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(x, F.lit("9")).cast("int"))))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


FORMS = (
    Form("email", "plain", EMAIL, None, ("@",), True),
    Form("ip", "four", IP, lambda m: m.rlike(OCTETS), (".",), True),
    Form("card", "checked", CARD, luhn, (), True),
    Form("phone", "plus", PHONE, lambda m: F.length(digits(m)).between(9, 15), ("+",), True),
    Form("email", "spelt", EMAIL_SPELT, None, ("dot",), False),
    Form("ip", "six", IP_SIX, None, (":",), False),
    Form("card", "groups", CARD_GROUPS, lambda m: ~luhn(m), (), False),
    Form("phone", "local", PHONE_LOCAL, None, (), False),
    Form("phone", "zeros", PHONE_ZEROS, lambda m: F.length(digits(m)).between(9, 17), ("00",), False),
    Form("secret", "run", SECRET_RUN, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), (), False),
    Form("secret", "set", SECRET_SET, None, ("=", ":"), False),
    Form("iban", "grouped", IBAN, None, (), False),
    Form("name", "titled", NAME, None, (), False),
    Form("address", "street", STREET, None, (), False),
)


def remainder_97(m: Column) -> Column:
    """The remainder of an IBAN's rearranged digits, taken digit by digit."""
    plain = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c == "", -1).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(moved, value), F.lit(0), lambda a, v: F.when(v < 0, a).when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def _votes(f: Form, m: Column, before: Column) -> list[Column]:
    """Regex, gazetteer and context labelers: 1, -1 or 0."""
    n, d = F.length(digits(m)), digits(m)
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    if f.kind == "email":
        shape = F.when(m.rlike(r"\.\.|^\.|-\.|\.-"), -1).when(m.rlike(r"[A-Za-z]{2,}$"), 1).otherwise(-1)
        known = F.when(ending.isin(ENDINGS), 1).otherwise(0)
    elif f.kind == "ip":
        shape = F.when(m.rlike(r"(^|\.)0[0-9]"), -1).otherwise(1)
        known = F.when(m.rlike(NOT_HOSTS), -1).otherwise(1) if f.base else F.when(m.rlike(r"^(?:2|3|f[cdef])"), 1).otherwise(-1)
    elif f.kind == "card":
        shape = F.when(n.isin(13, 14, 15, 16, 19), 1).otherwise(-1) if f.base else F.lit(-1)
        known = F.when(d.rlike(ISSUER), 1).otherwise(-1)
    elif f.kind == "secret":
        value = F.regexp_replace(m, rf"(?i)^{KEY_NAMES}[\"']?[ ]?[=:][ ]?[\"']?", "")
        shape = F.when((n >= 2) & value.rlike("[A-Za-z]"), 1).when(n > 0, 0).otherwise(-1)
        named = F.lit(True) if f.name == "set" else before.rlike(rf"{KEY_NAMES}[\"']?[ ]?[=:]?[ ]?[\"']?$")
        known = F.when(value.rlike(KEY_PREFIXES) | named, 1).when(before.rlike(HASH_NAMES), -1).otherwise(0)
        inside = before.rlike(r"(?:[/.@]|://\S*)$")  # a part of a path or an address
        return [shape, known, F.when(inside, -1).when(F.lit(f.name == "set") | before.rlike(WORDS_FOR["secret"]), 1).otherwise(0)]
    elif f.kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        length = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(IBAN_LENGTHS.items()) for x in pair]), F.substring(plain, 1, 2))
        shape = F.when(remainder_97(m) == 1, 1).otherwise(-1)
        known = F.when(length == F.length(plain), 1).when(length.isNotNull(), -1).otherwise(0)
    elif f.kind == "name":
        parts = F.split(F.lower(m), " ")
        shape = F.when(F.size(parts) > 2, 1).otherwise(0)
        known = F.when(F.get(parts, F.lit(1)).isin(*TITLE_WORDS), -1).when(F.get(parts, F.lit(1)).isin(*GIVEN_NAMES), 1).otherwise(0)
    elif f.kind == "address":
        shape = F.when(m.rlike("^[1-9]"), 1).otherwise(-1)
        known = F.when(m.rlike(r"^[0-9]{4} "), 0).otherwise(1)
    else:
        shape = F.when(n.between(10, 13), 1).otherwise(0) if f.base or f.name == "zeros" else F.when(m.rlike(r"^\(?[2-9]"), 1).otherwise(-1)
        known = F.when(d.rlike(CODES), 1).otherwise(-1) if f.base or f.name == "zeros" else F.when(d.rlike("^[2-9][0-8][0-9][2-9]"), 1).otherwise(-1)
    context = F.when(before.rlike(WORDS_AGAINST), -1).when(before.rlike(WORDS_FOR[f.kind]), 1).otherwise(0)
    return [shape, known, context]


def _around(c: Column) -> Column:
    """The class of a neighbouring character."""
    return F.when(c == "", "e").when(c.rlike(r"\s"), "s").when(c.rlike(r"[\p{L}]"), "l").when(c.rlike("[0-9]"), "d").otherwise("p")


def _candidates(text: Column, f: Form) -> Column:
    """The form's spans with their vote and shape keys. A match that fails ``valid`` is dropped after
    matching, without a retry. Positions are code points: the gaps between the matches give them."""
    kind = "array<struct<kind:int,s:int,e:int,base:boolean,key:string>>"
    none = F.array().cast(kind)

    def key(m: Column, left: Column, right: Column) -> Column:
        near = F.lower(F.substring(left, -40, 40))
        size = F.when(F.length(m) < 10, "a").when(F.length(m) < 16, "b").when(F.length(m) < 24, "c").otherwise("d")
        return F.concat_ws("|", F.lit(f.kind), F.lit(f.name), *[v.cast("string") for v in _votes(f, m, near)], size, _around(F.substring(left, -1, 1)), _around(F.substring(right, 1, 1)))

    def placed(m: Column, g: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a: Column, i: Column) -> Column:
            s = a["at"] + F.length(F.get(g, i))
            e = s + F.length(F.get(m, i))
            one = F.array(F.struct(F.lit(KINDS.index(f.kind)).alias("kind"), s.alias("s"), e.alias("e"), F.lit(f.base).alias("base"), key(F.get(m, i), F.get(g, i), F.get(g, i + 1)).alias("key")))
            good = f.valid(F.get(m, i)) if f.valid else F.lit(True)
            return F.struct(e.alias("at"), F.when(good, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), start, step, lambda a: a["out"])

    found = let(F.regexp_extract_all(text, F.lit(f.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, f.pattern, -1), lambda g: placed(m, g))).otherwise(none))
    return F.when(reduce(or_, [text.contains(x) for x in f.needs]), found).otherwise(none) if f.needs else found


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, base, more): base spans, and looser candidates that overlap none of them nor each other's betters."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.concat(*[_candidates(t, f) for f in FORMS if f.base]).alias("base"),
        F.concat(*[_candidates(t, f) for f in FORMS if not f.base]).alias("more"),
    )
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: meets(x, b)))
    return rows.select("id", "base", F.when(F.size("more") > 0, free).otherwise(F.col("more")).alias("more"))


def train(counts: dict[str, float], share: float = 0.9) -> set[str]:
    """The keys of looser candidates that the span classifier accepts (at probability ``share``).

    For each kind EM runs over the vote patterns, and its posteriors are the soft labels of a
    naive Bayes classifier whose features are the form, the three votes, the size and the two
    neighbouring characters of a span. The classifier sees the features alone, not the posterior
    itself; a value seen rarely says little, as its odds are drawn towards those of the kind. The
    number of keys is bounded by forms x 27 votes x 4 sizes x 25 neighbours."""
    accepted: set[str] = set()
    for kind in KINDS:
        own = {k: n for k, n in counts.items() if k.startswith(f"{kind}|")}
        votes: dict[weak.Votes, float] = defaultdict(float)
        for k, n in own.items():
            votes[_vote_of(k)] += n
        post = weak.fit(votes, prior=0.7, start=weak.by_balance, belief=BELIEF, weight=0.2)
        features = {k: list(enumerate(k.split("|")[1:])) for k in own}
        mass: dict[tuple[bool, int, str], float] = defaultdict(float)
        whole = {True: 1.0, False: 1.0}
        for k, n in own.items():
            p = post[_vote_of(k)]
            for real, m in ((True, n * p), (False, n * (1 - p))):
                whole[real] += m
                for j, v in features[k]:
                    mass[real, j, v] += m
        both = whole[True] + whole[False]
        rate = lambda real, j, v: (mass[real, j, v] + STRENGTH * (mass[True, j, v] + mass[False, j, v]) / both) / (whole[real] + STRENGTH)  # noqa: B023, E731
        for k in own:
            odds = math.log(whole[True] / whole[False]) + sum(math.log(rate(True, j, v)) - math.log(rate(False, j, v)) for j, v in features[k])
            if odds >= math.log(share / (1 - share)):
                accepted.add(k)
    return accepted


def _vote_of(key: str) -> weak.Votes:
    return tuple(int(v) for v in key.split("|")[2:5])


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then by start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(text, ",")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_added) for each row of ``docs``.

    The counts and ``base_spans`` are those of the base patterns; ``spans`` adds the looser
    candidates that the trained classifier accepts, ``n_added`` of them. Spans of one kind never
    meet; added ones meet no base span nor each other (the earlier, then the longer, then the kind
    listed first, counts). A null text is empty. A very long text is one row: every pattern reads it
    once, with bounded steps a character. Repeated rows each get a row; other columns are not read,
    whatever their names; an empty table gives an empty result. Candidates (a few dozen bytes each)
    are written to the checkpoint folder between training and use."""
    rows = checkpoint(candidates(docs, id_col, text))
    keys = rows.select(F.explode(F.concat("base", "more")).alias("c")).groupBy(F.col("c.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    accepted = train({r["key"]: float(r["n"]) for r in keys.collect()})
    table = F.array(*[F.lit(k) for k in sorted(accepted)]).cast("array<string>")
    more = F.filter("more", lambda x: F.array_contains(table, x["key"]))
    order = lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))
    # sorted by the order above, a span stays if it begins where the last that stayed has ended
    step = lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    kind = "array<struct<kind:int,s:int,e:int,base:boolean,key:string>>"
    sort = lambda xs: F.array_sort(xs, lambda x, y: F.when(order(x) < order(y), -1).when(order(x) > order(y), 1).otherwise(0))
    apart = F.aggregate(sort(more), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
    added = F.when(F.size("more") > 0, apart).otherwise(F.col("more"))
    judged = rows.select("id", "base", added.alias("added"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return judged.select("id", *[count(k) for k in BASE_KINDS], _joined(F.col("base")).alias("base_spans"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
