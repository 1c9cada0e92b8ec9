"""Structured Streaming over journals.

Each function takes a streaming (or plain) DataFrame and returns one, so the tests drive the
same plans that a cluster runs; :func:`ingest` writes with exactly-once output per batch."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgraph.functions import text as T
from quillgraph.operators import embed as E
from quillgraph.operators import journal as J
from quillgraph.sources import tables as ST
from quillgraph.sources.schema import ENTRY_DDL

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

LATE = "30 days"


def tail(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """Entries of a folder that writers drop closed files into; each file is read once."""
    return spark.readStream.schema(ENTRY_DDL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(directory)


def distinct_ids(entries: DataFrame) -> DataFrame:
    """The first arrival of each id within the watermark; later ones are dropped."""
    return entries.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["id"])


def split_corrupt(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound entries, and the texts of corrupt lines."""
    return entries.filter("_corrupt is null").drop("_corrupt"), entries.filter("_corrupt is not null").select("_corrupt")


def daily(entries: DataFrame) -> DataFrame:
    """T5: entries by tumbling day."""
    return entries.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


class Sessions(StatefulProcessor):
    """The open session number of a (worktree, agent): it grows after a final entry. State has no timeout."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number = handle.getValueState("number", "n long, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        n, closed = self.number.get() if self.number.exists() else (0, False)
        whole = pd.concat(list(rows)).sort_values(["ts", "id"])
        out = []
        for r in whole.itertuples():
            n, closed = n + bool(closed), bool(r.final)
            out.append((key[0], key[1], r.id, n))
        self.number.update((n, closed))
        yield pd.DataFrame(out, columns=["worktree", "agent", "id", "session_no"])

    def close(self) -> None:
        pass


def sessions(entries: DataFrame) -> DataFrame:
    """Each entry with the number of its session; batches must come in time order."""
    return entries.groupBy("worktree", "agent").transformWithStateInPandas(Sessions(), "worktree string, agent string, id string, session_no long", "Append", "None")


class LastStatus(StatefulProcessor):
    """The last status of a node; a row is emitted for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        prior = self.status.get()[0] if self.status.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("updated").itertuples():
            if prior is not None and r.status != prior:
                out.append((key[0], prior, r.status))
            prior = r.status
        self.status.update((prior,))
        yield pd.DataFrame(out, columns=["id", "prior", "status"])

    def close(self) -> None:
        pass


def task_events(changes: DataFrame) -> DataFrame:
    """Journal rows for status changes (id, status, updated): a plan, an outcome or a risk."""
    moved = changes.groupBy("id").transformWithStateInPandas(LastStatus(), "id string, prior string, status string", "Append", "None")
    kind = F.when(F.col("status") == "in_progress", "plan").when(F.col("status") == "done", "outcome").when(F.col("status") == "blocked", "risk")
    return moved.withColumn("kind", kind).filter("kind is not null")


def checked(entries: DataFrame, rules: Mapping[str, str] = T.SECRET_RULES) -> DataFrame:
    """Entries with their reason of rejection (null: accepted) and secrets redacted."""
    return entries.withColumn("reason", J.rejection()).withColumns({c: T.redact(F.col(c), rules) for c in ("summary", "detail")})


def ingest(entries: DataFrame, table: str, rejects: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Validate, redact, append once by id; rejects and corrupt lines go to ``rejects``.

    Each batch writes a folder of its own number, by hash bucket of the id, so a batch that runs again replaces its rows and
    one of few ids looks for them in few folders.
    ``every``: the interval of a stream that goes on ("60 seconds"); without one what is there
    is taken and the query ends."""

    def write(batch: DataFrame, number: int) -> None:
        rows = checked(batch)
        bad = F.col("reason").isNotNull() | F.col("_corrupt").isNotNull()
        spark = batch.sparkSession
        new = rows.filter(~bad).drop("reason", "_corrupt").dropDuplicates(["id"])
        there = ST.known(spark, table, "id", new, batch=number)
        new = new if there is None else new.join(there, "id", "left_anti")
        new.withColumn("bucket", ST.bucket(["id"])).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
        rows.filter(bad).write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def publish(entries: DataFrame, table: str, rejects: str, checkpoint: str, every: str = "60 seconds") -> Callable[[], None]:
    """Starts :func:`ingest` at intervals and returns the function that ends it: it stops the stream and
    takes, in one last flush from the same checkpoint, what came since the last interval."""
    query = ingest(entries, table, rejects, checkpoint, every)

    def finish() -> None:
        query.stop()
        ingest(entries, table, rejects, checkpoint).awaitTermination()

    return finish


def embed_new(entries: DataFrame, table: str, checkpoint: str, embedder: E.Embedder | None = None) -> StreamingQuery:
    """Vectors for the new entries of each batch worth one; the entries themselves are written elsewhere,
    so a failure here loses no entry, and a batch that runs again replaces its vectors. Contents that an earlier batch
    has embedded by the same model are not embedded again."""

    def write(batch: DataFrame, number: int) -> None:
        text = T.embedding_text(F.col("summary"), F.col("detail"))
        rows = batch.filter(F.col("kind").isin(*J.EMBEDDED_KINDS)).select(F.sha2(text, 256).alias("content_hash"), text.alias("text"))
        model = embedder or E.HashedWords()
        there = ST.known(batch.sparkSession, f"{table}/model={model.fingerprint}", "content_hash", rows, batch=number)
        none = batch.sparkSession.createDataFrame([], "content_hash string, model string")
        done = none if there is None else there.withColumn("model", F.lit(model.fingerprint))
        new = E.fill(done, rows, model).drop("model").withColumn("bucket", ST.bucket(["content_hash"]))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/model={model.fingerprint}/batch={number}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
