"""Quality rules by weak supervision.

Each rule reads counts of the whole text and votes: 1 (good), -1 (bad) or 0
(abstains). Expectation-maximisation over the counts of vote patterns estimates
how far each rule can be trusted, and a document's posterior probability of good
quality decides, in place of a filter that every rule must pass. The documents that
fail the base rules anchor what bad means; all others are free, so one negative vote
of a rule that often cries wolf does not drop a document that the others call good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import weak
from quillgraph.llm._spark import checkpoint, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Very common words of English, German, French and Spanish; prose of any length has some.
COMMON = (
    "the of and to in is that for it as with be on by this are "
    "der die das und den von zu mit ist nicht ein eine "
    "de la les le des et en que un une du el los las se con por para una"
).split()
#: White space as the word rules have it, for the inside of a bracket.
_S = r"\x20\x09-\x0D"
COMMON_WORD = rf"(?i)(?<![^{_S}])(?:{'|'.join(sorted(set(COMMON)))})(?![^{_S}])"
#: A word without a letter. The run is possessive, so each word is read once.
BARE_WORD = rf"(?<![^{_S}])[^{_S}\p{{L}}]++(?![^{_S}])"
#: What may follow the full stop of a line.
CLOSERS = " \t\x0b\x0c\r\"')]»”’"


def repeat_words(tokens: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that the text has twice or more.

    Windows are told apart by the 64-bit hash of their words' hashes. Where two are
    equal, the windows are sorted by hash; each start of a repeated window covers
    ``size`` words, or as many as there are before the next such start."""
    zero = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(starts, k + 1) - p, F.lit(size))))
        return F.aggregate(reach, zero, lambda a, x: a + x)

    def repeated(ranked: Column) -> Column:
        def alike(x: Column, k: Column) -> Column:
            before = F.get(ranked, F.greatest(k - 1, F.lit(0)))["h"]
            return (F.get(ranked, k + 1)["h"] == x["h"]) | ((k > 0) & (before == x["h"]))

        return F.array_sort(F.filter(F.transform(ranked, lambda x, k: F.when(F.coalesce(alike(x, k), F.lit(False)), x["i"])), lambda i: i.isNotNull()))

    def counted(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(ranked, lambda r: let(repeated(r), covered)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    return F.when(F.size(tokens) > size, let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted))).otherwise(zero)


def measures(text: Column) -> Column:
    """A struct of all counts that the rules read, each over the whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return F.struct(
        let(
            words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: F.right(F.rtrim(y, F.lit(CLOSERS)), F.lit(1)).isin(".", "!", "?"))).cast("long").alias("n_ended_lines"),
            ),
        ).alias("l"),
        F.regexp_count(t, F.lit(COMMON_WORD)).cast("long").alias("n_common"),
        F.regexp_count(t, F.lit(BARE_WORD)).cast("long").alias("n_bare"),
        F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_shouts"),
    )


def votes(m: Column) -> list[Column]:
    """The rules over the counts; thresholds are shares of words, letters or lines."""
    n, n1 = m["w"]["n_words"], F.greatest(m["w"]["n_words"], F.lit(1))
    chars = F.greatest(m["w"]["word_chars"], F.lit(1))
    lines = F.greatest(m["l"]["n_lines"], F.lit(1))

    def rule(value: Column, good: float, bad: float, least: int = 1) -> Column:
        """Bad above ``bad``, good up to ``good``; abstains between and below ``least`` words."""
        return F.when(n < least, 0).when(value > bad, -1).when(value <= good, 1).otherwise(0)

    length = m["w"]["word_chars"] / n1
    common = m["n_common"] / n1
    ended = m["l"]["n_ended_lines"] / lines
    return [
        F.when(n < 50, -1).when(n >= 100, 1).otherwise(0),
        F.when(n < 1, 0).when((length < 3) | (length > 10), -1).when((length >= 3.5) & (length <= 7), 1).otherwise(0),
        rule(m["n_symbols"] / n1, 0.02, 0.1, 5),
        rule(m["l"]["n_dup_lines"] / lines, 0.15, 0.5, 5),
        rule(m["w"]["n_repeat_words"] / n1, 0.1, 0.3, 5),
        rule(m["n_bare"] / n1, 0.1, 0.2, 5),
        F.when(n < MIN_WORDS, 0).when((m["n_common"] < 2) | (common < 0.02), -1).when(common >= 0.06, 1).otherwise(0),
        F.when(n < 1, 0).when(ended < 0.5, -1).when(ended >= 0.9, 1).otherwise(0),
        rule(m["n_upper"] / chars, 0.1, 0.3, 5),
        rule(m["n_shouts"] / n1, 0.05, 0.2, 5),
        rule(m["n_digits"] / chars, 0.05, 0.2, 5),
    ]


def ballot(m: Column) -> Column:
    """The votes of all rules as an array."""
    return F.array(*[v.cast("int") for v in votes(m)])


def lookup(posterior: dict[tuple[int, ...], float], key: Column) -> Column:
    """The posterior of a vote pattern; the table has the patterns that occur, at most 3 ** rules."""
    if not posterior:
        return F.lit(None).cast("double")
    pairs = [x for p, v in sorted(posterior.items()) for x in (F.lit(",".join(map(str, p))), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(",", F.transform(key, lambda v: v.cast("string"))))


def failed(m: Column) -> Column:
    """The base rules."""
    n = m["w"]["n_words"]
    return (n < MIN_WORDS) | (100 * m["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def score(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, the counts, ``base_failed``,
    ``quality`` (the posterior), ``n_against`` (the rules that vote -1) and ``kept``.

    A null or empty text has no words and fails the base rules. A very long text is one row like
    any other: every count is one pass over it, but for the windows, which are sorted. Repeated
    rows each get a row, with equal results; rows with equal counts have equal posteriors, so
    ties need no rule. Other columns of ``docs`` are not read. An empty table gives an empty result.

    One pass over the texts writes the counts to the checkpoint folder (a few dozen
    bytes a document); the vote patterns are counted over all documents and only
    these counts, at most 2 * 3 ** 11 however many documents there are, come to the driver."""
    measured = checkpoint(docs.select(*[F.col(f"`{c}`") for c in keep], measures(F.col(f"`{text}`")).alias("_m")))
    m = F.col("_m")
    voted = measured.withColumns({"_v": ballot(m), "_f": failed(m)})
    judged = voted.select(
        *[F.col(f"`{c}`") for c in keep],
        m["w"]["n_words"].alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        F.col("_f").alias("base_failed"),
        lookup(fitted(voted.select("_v", "_f")), F.col("_v")).alias("quality"),
        F.size(F.filter("_v", lambda v: v < 0)).cast("long").alias("n_against"),
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("quality"), F.lit(0.0)) >= threshold))


def fitted(ballots: DataFrame) -> dict[tuple[int, ...], float]:
    """Posteriors of the vote patterns in ``_v``; the rows whose ``_f`` is true (they fail the base rules) are the bad anchors."""
    counts = ballots.groupBy("_v", "_f").agg(F.count(F.lit(1)).alias("n")).collect()
    pattern = lambda bad: {tuple(r["_v"]): float(r["n"]) for r in counts if r["_f"] == bad}
    return weak.fit(pattern(False), pattern(True))


def filter_docs(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with their columns as they were.

    One pass over the texts writes each row with its ballot to the checkpoint folder; the fit and
    the filter read that, so no text is measured twice and none is shuffled. Columns of
    ``docs`` may have any names. Nulls, long texts, ties and an empty table: as :func:`score`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = let(measures(F.col(f"`{text}`")), lambda m: F.struct(ballot(m).alias("v"), failed(m).alias("f"))).alias("_j")
    voted = checkpoint(docs.select(row, judged)).select("_row", F.col("_j.v").alias("_v"), F.col("_j.f").alias("_f"))
    posterior = fitted(voted.select("_v", "_f"))
    return voted.filter(~F.col("_f") & (F.coalesce(lookup(posterior, F.col("_v")), F.lit(0.0)) >= threshold)).select("_row.*")
