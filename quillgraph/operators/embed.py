"""Embeddings as data: store, coverage, fill and prune."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Embedder(Protocol):
    """Anything with a fingerprint, a number of dimensions and a batch method."""

    fingerprint: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """The default: a bag of words hashed into a unit vector, the same on every machine."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self.fingerprint = f"hashed-words-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % self.dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def current(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors (id, content_hash ...) of nodes whose content is still the same."""
    return vectors.join(nodes.select("id", "content_hash"), ["id", "content_hash"], "left_semi")


def shared(store: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node with the vector of its content; one vector serves all nodes of equal content."""
    return nodes.select("id", "node_type", "content_hash").join(store, "content_hash")


def missing(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (content_hash ...) without a vector."""
    return rows.join(store.select("content_hash"), "content_hash", "left_anti")


def coverage(store: DataFrame, nodes: DataFrame) -> DataFrame:
    """A10: nodes and nodes with a vector, by type."""
    have = store.select("content_hash").distinct().withColumn("_has", F.lit(1))
    return nodes.join(have, "content_hash", "left").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.count("_has").alias("n_embedded"))


def _embed(batches: Iterator[pa.RecordBatch], embedder: Embedder, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            got = embedder.embed([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("content_hash"), pa.array([embedder.fingerprint] * len(got)), pa.array([embedder.dim] * len(got), pa.int32()), pa.array(got.tolist(), pa.list_(pa.float32()))], names=["content_hash", "model", "dim", "embedding"])


def fill(store: DataFrame, rows: DataFrame, embedder: Embedder | None = None, batch: int = 128) -> DataFrame:
    """Vectors for the distinct contents of ``rows`` (content_hash, text) that the model's part of
    the store lacks, in the store's columns; another fingerprint starts from nothing."""
    model = embedder or HashedWords()
    own = store.filter(F.col("model") == model.fingerprint)
    todo = missing(own, rows.groupBy("content_hash").agg(F.first("text").alias("text"))).select("content_hash", "text")
    return todo.mapInArrow(lambda b: _embed(b, model, batch), "content_hash string, model string, dim int, embedding array<float>")


def prune(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors whose node left the graph."""
    return vectors.join(nodes.select("id"), "id", "left_anti")
