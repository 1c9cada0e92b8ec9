"""URL filters with dated lists.

Each list entry adds or removes a value at a time. The entries of a value become validity
intervals, and every capture is judged by the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the time buckets that intervals and captures are joined on.
BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path without query, fragment and final slash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*?)/?(?:[?#]|$)", 1)


def values_of(url: Column, depths: list[int] | None = None) -> Column:
    """All values that can list a URL: its host, each parent domain and host with path.

    ``depths``: numbers of labels that listed domains have; others are left out."""
    labels = F.split(host_of(url), r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    if depths is not None:
        places = F.filter(places, lambda k: (F.size(labels) - k + 1).isin(*depths)) if depths else F.array().cast("array<int>")
    suffixes = F.transform(places, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    page = F.when(path_of(url) != "", F.array(F.concat(host_of(url), path_of(url)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_remove(F.concat(suffixes, page), ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(value, category, since, until): half-open times at which a value is listed.

    ``entries`` has value, category, at, action ('add' or 'remove'). Each entry holds until
    the next of its value; of several at one time the last by (action, category) holds, so
    a removal beats an addition. Entries without value or time say nothing."""
    last = entries.filter("value is not null and at is not null").groupBy("value", "at").agg(F.max(F.struct("action", "category")).alias("e"))
    upto = F.lead("at").over(Window.partitionBy("value").orderBy("at"))
    spans = last.select("value", F.col("e.category").alias("category"), F.col("at").alias("since"), upto.alias("until"), F.col("e.action").alias("action"))
    return spans.filter("action = 'add'").drop("action")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """(id, url, fetched, listed, value, category, since) for each row of ``captures``.

    Of several active entries that match, the longest value counts (then the greatest). A
    null URL or fetch time matches nothing. A very long URL has a value for each label of its
    host. Repeated rows each get a row; other columns are not read, whatever their names; empty
    captures give an empty result and empty entries list nothing.

    The different numbers of labels that the list's domains have (DNS has at most 127, whatever
    the list's length) come to the driver first, so that a capture is not sent to "com" if no
    such domain is listed.

    Intervals are cut at bucket borders and joined on (value, bucket) with the range as a
    condition, so a capture meets the few intervals near its time, and Spark can split a
    value with a third of all captures."""
    width = BUCKET_DAYS * 86400
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    rows = captures.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").alias("fetched"))
    ends = rows.agg(F.min("fetched"), F.max("fetched")).first()
    spans = intervals(entries)
    if ends[0] is not None:
        low, high = F.lit(ends[0]), F.lit(ends[1])
        spans = spans.filter((F.col("since") <= high) & (F.coalesce("until", high) >= low))
        spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("since", low)), bucket(F.least(F.coalesce("until", high), high)))))
    else:
        spans = spans.withColumn("bucket", F.lit(0).cast("long"))
    domains = spans.filter(~F.col("value").contains("/")).select(F.size(F.split("value", r"\.")).alias("n"))
    depths = [r["n"] for r in domains.distinct().collect()]
    keys = rows.select("*", F.explode_outer(values_of(F.col("url"), depths)).alias("_value"), bucket("fetched").alias("_bucket"))
    on = (F.col("_value") == F.col("value")) & (F.col("_bucket") == F.col("bucket")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = keys.join(spans, on, "left")
    best = F.max(F.when(F.col("value").isNotNull(), F.struct(F.length("value").alias("n"), "value", "category", "since"))).alias("_best")
    found = met.groupBy("_row", "id", "url", "fetched").agg(best)
    return found.select("id", "url", "fetched", F.col("_best").isNotNull().alias("listed"), "_best.value", "_best.category", "_best.since")
