"""Journal sessions as files: open ones with their companions, and the dated archive.

A session of id ``<id>`` is open as ``<id>.jsonl`` with ``<id>.meta.json`` beside it and, once it has ended, an
empty ``<id>.ready``. An archived one is ``archive/YYYY/MM/DD/<id>/entries.jsonl`` with ``meta.json`` beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.sources.schema import ENTRY_DDL

META_DDL = "v int, session_id string, created_utc timestamp, agent string, worktree_hash string, repo_root string, branch string, head string, _corrupt string"
#: The archive's layout: three parts of the day, the session, one of its two files.
ARCHIVED = r"/(archive/\d{4}/\d\d/\d\d/([^/]+))/(entries\.jsonl|meta\.json)$"
STAMP = ("path", "length", "modificationTime")


def _entries(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """Entries with the path that they come from; a line that is no entry keeps its text in ``_corrupt``."""
    reader = spark.read.schema(ENTRY_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.json(directory).withColumn("path", F.col("_metadata.file_path"))


def _name(path: Column) -> Column:
    """The file's name up to the first dot: the session of an open file."""
    return F.regexp_extract(path, r"([^/.]+)\.[^/]*$", 1)


def session_files(spark: SparkSession, directory: str) -> DataFrame:
    """(session_id, has_entries, has_meta, ready) of each session with a file in ``directory``. Files of other
    kinds, and names that are no session id, are passed over. The names come from the listing that Spark's driver holds
    for any scan of the folder: a scan itself leaves out empty files, which markers and new sessions are."""
    kind = F.regexp_extract("path", r"\.(jsonl|meta\.json|ready)$", 1)
    has = lambda k: F.bool_or(F.col("kind") == k)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json,ready}").load(directory).inputFiles()
    files = spark.createDataFrame([(x,) for x in names], "path string").select(_name(F.col("path")).alias("session_id"), kind.alias("kind"))
    return files.filter(F.col("session_id").rlike(T.SESSION) & (F.col("kind") != "")).groupBy("session_id").agg(has("jsonl").alias("has_entries"), has("meta.json").alias("has_meta"), has("ready").alias("ready"))


def session_counts(files: DataFrame) -> DataFrame:
    """One row of open and ready sessions. A marker without entries counts as neither: its session is archived."""
    return files.filter("has_entries").agg(F.count_if(~F.col("ready")).alias("n_open"), F.count_if("ready").alias("n_ready"))


def session_meta(spark: SparkSession, directory: str) -> DataFrame:
    """The metadata of each ``*.meta.json`` with ``problem``: 'corrupt' for a file that is no such JSON object or lacks
    an agent, 'mismatch' for one that tells another session than its name. ``session_id`` is that of the name."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").text(directory, wholetext=True)
    m = F.from_json("value", META_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = texts.select(_name(F.col("_metadata.file_path")).alias("_id"), m.alias("m")).select("_id", "m.*")
    lacking = F.col("_corrupt").isNotNull() | F.col("session_id").isNull() | F.col("agent").isNull()
    problem = F.when(lacking, "corrupt").when(F.col("session_id") != F.col("_id"), "mismatch")
    return read.filter(F.col("_id").rlike(T.SESSION)).withColumn("problem", problem).withColumn("session_id", F.col("_id")).drop("_id", "_corrupt")


def resumable(files: DataFrame, meta: DataFrame) -> DataFrame:
    """(worktree_hash, agent, session_id): the newest session of each worktree and agent that has not ended. The worktree is
    the one that the id names; ids of one worktree are ordered by their time."""
    alive = meta.filter("problem is null").join(files.filter("not ready"), "session_id", "left_semi")
    named = alive.withColumn("worktree_hash", F.regexp_extract("session_id", T.SESSION, 2))
    return named.groupBy("worktree_hash", "agent").agg(F.max("session_id").alias("session_id"))


def archived_files(spark: SparkSession, directory: str, known: DataFrame | None = None) -> DataFrame:
    """(session_id, path, length, modificationTime, problem): the archived sessions below ``directory``. ``known`` (path, length,
    modificationTime) are those read before; they are left out while they are unchanged.

    ``problem`` is 'no entries' for a session that has metadata alone and 'misplaced' for one whose folder is not that of
    its id's date (its path is null in the first case). Contents are not read; an empty file of entries is as none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{entries.jsonl,meta.json}").load(directory)
    found = files.select(*STAMP).filter(F.col("path").rlike(ARCHIVED))
    part = lambda k: F.regexp_extract("path", ARCHIVED, k)
    file = F.when(part(3) == "entries.jsonl", F.struct(*STAMP))
    rows = found.groupBy(part(2).alias("session_id"), part(1).alias("folder")).agg(F.max(file).alias("f"))
    problem = F.when(F.col("f").isNull(), "no entries").when(~F.col("folder").eqNullSafe(T.archive_path(F.col("session_id"))), "misplaced")
    out = rows.select("session_id", "f.*", problem.alias("problem"))
    return out if known is None else out.join(known.select(*STAMP), list(STAMP), "left_anti").select("session_id", *STAMP, "problem")


def archived_entries(spark: SparkSession, directory: str, files: DataFrame) -> DataFrame:
    """ENTRIES rows of the archived sessions ``files`` (of :func:`archived_files`) that have no problem, with the session of
    their folder as ``archived_session``. Lines that are no entry keep their text in ``_corrupt``."""
    good = files.filter("problem is null").select(F.col("session_id").alias("archived_session"), "path")
    return _entries(spark, directory, "entries.jsonl").join(good, "path").drop("path")


def open_entries(spark: SparkSession, directory: str, files: DataFrame) -> DataFrame:
    """Entries of the open folder, with ``ready``, whether their session has ended."""
    e = _entries(spark, directory, "*.jsonl")
    return e.withColumn("_id", _name(F.col("path"))).join(files.select(F.col("session_id").alias("_id"), "ready"), "_id").drop("path", "_id")
