"""Stored tables with a manifest.

A table is a folder of versions, each a folder of Parquet parts by hash bucket of the key, and of manifests that
name the current one. A version is written whole before its manifest, whose creation is the switch: readers see the
version before or the one after, and a writer that dies leaves a folder without a manifest."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The layout that this code writes; tables of another are built anew.
LAYOUT = 1
BUCKETS = 16
MANIFEST = re.compile(r"manifest-(\d{12})\.json$")


@dataclass(frozen=True)
class Manifest:
    """What a version holds: its layout, the user's schema version, the key, buckets, rows, the folder and the columns."""

    layout: int
    schema: str
    key: list[str]
    buckets: int
    rows: int
    folder: str
    columns: str


def bucket(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path), the newest first."""
    p, files = _files(spark, path)
    if not files.exists(p):
        return []
    names = [s.getPath().toString() for s in files.listStatus(p)]
    return sorted(((int(m[1]), n) for n in names if (m := MANIFEST.search(n))), reverse=True)


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest; None where there is none, it cannot be read, or its folder is gone."""
    for _, name in _manifests(spark, path)[:1]:
        try:
            found = Manifest(**json.loads("".join(r.value for r in spark.read.text(name, wholetext=True).collect())))
            p, files = _files(spark, f"{path}/{found.folder}")
            return found if files.exists(p) else None
        except (ValueError, TypeError):
            return None
    return None


def current(spark: SparkSession, path: str, schema: str) -> Manifest | None:
    """The manifest of a table that can be used as it is: of this layout and the wanted schema version."""
    found = manifest(spark, path)
    return found if found is not None and (found.layout, found.schema) == (LAYOUT, schema) else None


def read(spark: SparkSession, path: str, found: Manifest | None = None) -> DataFrame:
    """The rows of a version, without their buckets; a filter on ``bucket`` before that prunes folders."""
    found = found or manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.schema(StructType.fromJson(json.loads(found.columns))).parquet(f"{path}/{found.folder}")


def write(df: DataFrame, path: str, schema: str, key: Sequence[str], buckets: int = BUCKETS) -> Manifest:
    """``df`` as the table's next version. Of two writers of one number the second fails, and its folder stays unread."""
    spark = df.sparkSession
    number = (_manifests(spark, path)[:1] or [(0, "")])[0][0] + 1
    folder = f"version-{number:012d}-{uuid.uuid4().hex[:8]}"
    df.withColumn("bucket", bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    p, files = _files(spark, f"{path}/{folder}")
    columns = df.withColumn("bucket", F.lit(0)).schema
    rows = spark.read.schema(columns).parquet(f"{path}/{folder}").count()
    made = Manifest(LAYOUT, schema, list(key), buckets, rows, folder, columns.json())
    p, files = _files(spark, f"{path}/manifest-{number:012d}.json")
    out = files.create(p, False)
    out.write(json.dumps(asdict(made)).encode())
    out.close()
    return made


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all versions but the newest ``keep``, manifests first, and folders older than these without a manifest; how many."""
    p, files = _files(spark, path)
    kept = [name for _, name in _manifests(spark, path)[:keep]]
    oldest = min((int(MANIFEST.search(n)[1]) for n in kept), default=0)
    gone = 0
    for name in sorted(s.getPath().toString() for s in files.listStatus(p)) if files.exists(p) else []:
        number = re.search(r"/(?:manifest|version)-(\d{12})[^/]*$", name)
        if number and int(number[1]) < oldest:
            files.delete(_files(spark, name)[0], True)
            gone += name.endswith(".json") or 0
    return gone


def refresh(spark: SparkSession, path: str, schema: str, key: Sequence[str], source: DataFrame, content: str, derive: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Brings a table up to its source and tells what changed: {rebuilt, added, changed, removed, unchanged}.

    ``source`` has one row a ``key`` with a ``content`` hash. Rows of an unchanged content are carried over as they are stored;
    ``derive`` (expensive columns) runs only over new and changed ones. Where the stored version cannot be used (none,
    unreadable, another layout or schema), all is built anew. A refresh without a change writes nothing."""
    make = derive or (lambda df: df)
    found = current(spark, path, schema)
    if found is None:
        made = write(make(source), path, schema, key)
        return {"rebuilt": 1, "added": made.rows, "changed": 0, "removed": 0, "unchanged": 0}
    stored = read(spark, path, found).drop("bucket")
    own = source.select(*key, F.col(content).alias("_new"))
    state = stored.select(*key, F.col(content).alias("_old"), F.lit(1).alias("_stored")).join(own.withColumn("_own", F.lit(1)), list(key), "full")
    kind = F.when(F.col("_stored").isNull(), "added").when(F.col("_own").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    kinds = state.select(*key, kind.alias("_kind"))
    n = {r["_kind"]: r["n"] for r in kinds.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n.get(k) for k in ("added", "changed", "removed")):
        fresh = make(source.join(kinds.filter("_kind in ('added', 'changed')").select(*key), list(key), "left_semi"))
        kept = stored.join(kinds.filter("_kind = 'unchanged'").select(*key), list(key), "left_semi")
        write(kept.unionByName(fresh.select(*stored.columns)), path, schema, key, found.buckets)
    return {"rebuilt": 0, **{k: n.get(k, 0) for k in ("added", "changed", "removed", "unchanged")}}


def known(spark: SparkSession, path: str, key: str, keys: DataFrame, buckets: int = BUCKETS, batch: int | None = None) -> DataFrame | None:
    """The ``key`` values of a table of batches (``batch=<n>/bucket=<k>``) that may be among ``keys``: only the buckets of these
    are read, and of them the key alone. None for a table without batches; ``batch``: one that does not count."""
    p, files = _files(spark, path)
    if not files.exists(p):
        return None
    asked = [r["bucket"] for r in keys.select(bucket([key], buckets)).distinct().collect()]  # at most ``buckets`` numbers
    there = spark.read.option("basePath", path).parquet(path).filter(F.col("bucket").isin(asked))
    return (there if batch is None else there.filter(F.col("batch") != batch)).select(key)
