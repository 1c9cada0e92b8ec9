"""All queries of the library, by key, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import graph_queries, journal_queries, more_queries, retrieval_queries, store_queries, text_queries, workflow_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (graph_queries, journal_queries, text_queries, retrieval_queries, workflow_queries, more_queries, store_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
