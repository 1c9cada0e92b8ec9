"""A streaming source of lines of files that grow.

The offset is, for each file, the place after its last whole line. A trailing line without a newline stays until
it has one; a file that has become shorter than its offset is read again from its beginning, so sinks
deduplicate by id (T2). New bytes are cut into ranges, one a task, so a long backlog is not one task's work."""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillgraph.sources.schema import ENTRY_DDL

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
NAME = "growing_lines"
DDL = "value string, file string, at long"
SCHEMA = pa.schema([("value", pa.string()), ("file", pa.string()), ("at", pa.int64())])
#: Bytes of a range, of a look at a file's end, and rows of a batch.
RANGE, LOOK, ROWS = 64 << 20, 1 << 16, 1 << 14


@dataclass
class Lines(InputPartition):
    """The lines of ``file`` that begin in [start, stop); ``first``: a line begins at ``start`` for certain."""

    file: str
    start: int
    stop: int
    first: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that the driver and all executors can reach."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_end(system: fs.FileSystem, file: str, size: int) -> int:
    """The place after the last newline among the first ``size`` bytes, found backwards from the end."""
    with system.open_input_file(file) as f:
        stop = min(size, f.size())
        while stop > 0:
            start = max(0, stop - LOOK)
            f.seek(start)
            found = f.read(stop - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return 0


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, glob: str, size: int) -> None:
        self.path, self.glob, self.size = path, glob, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, folder = opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return {i.path: whole_end(system, i.path, i.size) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and fnmatch(i.base_name, self.glob)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            begin = 0 if begin > stop else begin
            out += [Lines(file, at, min(at + self.size, stop), at == begin) for at in range(begin, stop, self.size)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        rows: list[tuple[str, str, int]] = []
        with system.open_input_file(partition.file) as raw:
            at = partition.start if partition.first else partition.start - 1
            raw.seek(at)
            f = io.BufferedReader(raw, LOOK)
            if not partition.first:  # the line that holds the byte before belongs to the range before
                at += len(f.readline())
            while at < partition.stop and (line := f.readline()).endswith(b"\n"):
                text = line[:-1].decode("utf-8", "replace")
                if text.strip():
                    rows.append((text, partition.file, at))
                at += len(line)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class GrowingLines(DataSource):
    """Options: ``path``; ``glob`` of file names (*.jsonl); ``range``, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return DDL

    def streamReader(self, schema: object) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("glob", "*.jsonl"), int(self.options.get("range", RANGE)))


def lines(spark: SparkSession, directory: str, glob: str = "*.jsonl", size: int = RANGE) -> DataFrame:
    """(value, file, at): the whole lines of a folder's growing files, each once as long as no file shrinks."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("glob", glob).option("range", size).load(directory)


def tail(spark: SparkSession, directory: str, size: int = RANGE) -> DataFrame:
    """Entries of journals that writers append to; a corrupt line keeps its text in ``_corrupt``."""
    parsed = F.from_json("value", ENTRY_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines(spark, directory, size=size).select(parsed.alias("e")).select("e.*")
