"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of (source, language, topic); the cells' weights
are raked until their sums over each of the three match its target shares. A document's
sampling probability is its cell's factor, scaled so that the largest is 1 or, with a
token budget, so that the expected tokens are that share of all: then cells whose scaled
factor passes 1 are kept whole, and no small cell sets the rate of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm._spark import UPPER, checkpoint, let, words

AXES = ("source", "lang", "topic")
#: Raking ends when no sum misses its target by more than this share of it.
TOLERANCE = 1e-9
#: It also ends when the largest miss has not fallen below this share of what it was a stretch before.
SLOWEST = 0.95
#: Iterations between two checkpoints of the (small) cell table.
STRETCH = 5
#: Words that tell a topic, in English, German, French and Spanish (ASCII, lower case).
TOPICS = {
    "law": "law court legal license licence licensed copyright rights liability warranty contract attorney clause gesetz gericht recht vertrag lizenz haftung loi tribunal droit contrat licence ley derecho contrato licencia".split(),
    "technology": "software hardware computer internet algorithm server database code programming network token password rechner netzwerk programm logiciel ordinateur reseau servidor programa ordenador".split(),
    "health": "health medical patient hospital doctor disease treatment medicine clinical therapy gesundheit arzt krankheit patientin medizin sante maladie traitement medecin salud enfermedad tratamiento medico".split(),
    "finance": "bank money market price stock investment tax credit budget profit geld markt preis steuer aktie banque argent marche prix impot banco dinero mercado precio impuesto".split(),
    "science": "science research theory experiment energy physics chemistry biology analysis hypothesis forschung theorie versuch wissenschaft recherche theorie energie ciencia investigacion energia teoria".split(),
    "sport": "sport game team player match league goal coach championship season spiel mannschaft spieler trainer jeu equipe joueur partido equipo jugador liga".split(),
}
GENERAL = "general"


def token_count(text: Column) -> Column:
    """White-space words, the unit in which shares are counted here."""
    return F.size(words(text)).cast("long")


def topic_of(text: Column) -> Column:
    """The topic of whose words (``TOPICS``) the text has the most different ones, the first listed of several;
    ``GENERAL`` if it has none. Words are runs of ASCII letters, A-Z in lower case.

    The text is split once and met with one list of all topics' words, so the work does not grow with the topics."""
    known = sorted({w for ws in TOPICS.values() for w in ws})
    own = F.array_intersect(F.array(*map(F.lit, known)), F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), "[^a-z]+", -1))

    def best(found: Column) -> Column:
        scores = F.array(*[F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, ws)))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(TOPICS.items())])
        return F.when(F.size(found) == 0, GENERAL).otherwise(F.array_max(scores)["name"])

    return let(own, best)


def cells(rows: DataFrame) -> DataFrame:
    """Token sums of (source, lang, topic); null is a value of its own, written as an empty string."""
    return rows.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")


def tempered(table: DataFrame, alpha: float) -> DataFrame:
    """``table`` with the target sums t_<axis>: shares proportional to tokens ** alpha, of the same total.

    alpha 1 keeps the mixture as it is, 0 makes all values of an axis equal. Only the
    total and one normaliser an axis come to the driver."""
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    out = table
    for axis in AXES:
        sums = table.groupBy(axis).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("p"))
        whole = sums.agg(F.sum("p")).first()[0] or 1.0
        out = out.withColumn(f"t_{axis}", F.pow(F.sum("tokens").over(Window.partitionBy(axis)), F.lit(alpha)) * F.lit(total / whole))
    return out


def rake(table: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``weight``: tokens scaled so that its sums over each axis match t_source, t_lang, t_topic.

    One iteration scales to the three targets in turn; iterations end when all sums meet their
    targets, or when the misses have stopped falling: targets that the cells cannot reach together
    are met in the last axis and approached in the others. The table has a row for each cell
    that occurs, whatever the number of documents; every few iterations it is checkpointed and the
    largest miss comes to the driver."""
    now, last = table.withColumn("weight", F.col("tokens")), None
    summed = lambda axis: F.sum("weight").over(Window.partitionBy(axis))
    while True:
        for _ in range(STRETCH):
            for axis in AXES:
                now = now.withColumn("weight", F.col("weight") * F.col(f"t_{axis}") / summed(axis))
        now = checkpoint(now)
        miss = now.select(F.greatest(*[F.abs(summed(axis) / F.col(f"t_{axis}") - 1) for axis in AXES]).alias("m")).agg(F.max("m")).first()[0]
        if miss is None or miss <= tolerance or (last is not None and miss > SLOWEST * last):
            return now
        last = miss


def uniform(id_col: Column) -> Column:
    """A fixed number in [0, 1) for an id: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weigh(docs: DataFrame, alpha: float = 0.7, id_col: str = "doc_id", text: str = "text", topic: str | None = None, tolerance: float = TOLERANCE, keep: tuple[str, ...] = (), budget: float | None = None) -> DataFrame:
    """(id, source, lang, topic, tokens, probability, kept and ``keep``) for each row of ``docs``.

    ``kept`` is drawn by the id alone, so a run can be repeated and repeated rows share
    their fate. Null source, language or topic counts as ''. A document without tokens
    weighs nothing towards any target and is kept with probability 1. A very long text counts
    with all its tokens. ``topic`` names a column of topics; without one they come from the
    texts (:func:`topic_of`). Columns in ``keep`` whose name is one of the result's go by
    ``keep_`` and their name. An empty table gives an empty result. Other columns are not read."""
    t = F.col(f"`{text}`")
    own = ("id", "source", "lang", "topic", "tokens", "probability", "kept")
    more = F.struct(F.lit(True), *[F.col(f"`{c}`").alias(f"keep_{c}" if c in own else c) for c in keep]).alias("_keep")
    about = F.struct(token_count(t).alias("tokens"), (_named(topic) if topic else topic_of(t)).alias("topic")).alias("_m")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _named("source").alias("source"), _named("lang").alias("lang"), about, more)
    rows = rows.select("id", "source", "lang", "_m.*", "_keep")
    names = [f"keep_{c}" if c in own else c for c in keep]
    return sample(rows, factors(rows, alpha, tolerance, budget)).select(*own, *[F.col(f"_keep.`{c}`") for c in names])


def _named(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def factors(rows: DataFrame, alpha: float, tolerance: float = TOLERANCE, budget: float | None = None) -> DataFrame:
    """(source, lang, topic, probability) for each cell of ``rows``.

    ``budget``: the expected share of all tokens to keep; without one the largest factor becomes 1."""
    raked = rake(checkpoint(tempered(checkpoint(cells(rows)), alpha)), tolerance)
    share = raked.select(*AXES, "tokens", (F.col("weight") / F.col("tokens")).alias("factor"))
    if budget is not None:
        share = checkpoint(share)  # read once a round of the scale's search
        return share.select(*AXES, F.least(F.lit(1.0), F.col("factor") * F.lit(scale(share, budget))).alias("probability"))
    top = share.agg(F.max("factor")).first()[0] or 1.0
    return share.select(*AXES, (F.col("factor") / F.lit(top)).alias("probability"))


def scale(share: DataFrame, budget: float) -> float:
    """The c of which min(1, c * factor) keeps ``budget`` of the tokens of ``share`` (tokens, factor).

    Cells that pass 1 are taken whole and the rest of the budget is dealt to the others,
    until no more pass: the set only grows, so the rounds end. Sums alone come to the driver."""
    if not 0.0 < budget <= 1.0:
        raise ValueError("budget is a share of the tokens: above 0 and at most 1")
    c, whole = 0.0, -1
    while True:
        full = F.col("factor") * F.lit(c) >= 1.0
        n, cells_n, fixed, loose, total = share.agg(F.count_if(full), F.count(F.lit(1)), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("factor"))), F.lit(0.0)), F.sum("tokens")).first()
        if n == whole or n == cells_n:
            return c
        whole, c = n, max(c, (budget * total - fixed) / loose)


def sample(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joins each row to its cell (the cells' table is broadcast if Spark finds it small
    enough; beyond that Spark splits hot sources) and draws."""
    joined = rows.join(table, list(AXES), "left")
    p = F.coalesce(F.col("probability"), F.lit(1.0))
    return joined.withColumn("probability", p).withColumn("kept", uniform(F.col("id")) < p)


def mix_docs(docs: DataFrame, alpha: float = 0.9, id_col: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, budget: float | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`weigh` keeps, with their columns as they were, whatever their names.

    Texts are measured twice (for the cells and for the draw) rather than shuffled or stored: the
    cells' table is joined to the rows by broadcast where Spark finds it small. Nulls, long texts,
    repeated rows and an empty table: as :func:`weigh`."""
    t = F.col(f"`{text}`")
    marks = F.struct(token_count(t).alias("tokens"), topic_of(t).alias("topic")).alias("_m")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), _named("source").alias("source"), _named("lang").alias("lang"), marks)
    rows = rows.select("_row", "id", "source", "lang", "_m.tokens", "_m.topic")
    return sample(rows, factors(rows.drop("_row"), alpha, tolerance, budget)).filter("kept").select("_row.*")
