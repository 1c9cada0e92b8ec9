"""Registered queries against their SQL twins in DuckDB; QUILLGRAPH_ALL=1 compares all of them."""

import datetime
import math
import os

import duckdb
import pytest

from quillgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "M2_repair J4_disallowed J6_as_of_join V2_bfs_edge_types A3_totals W2_distinct_summaries K12_range_digest K13_path_digest P8_body_section P12_slug P24_high_entropy K1_keyword_search K3_vector_search K4_hybrid K6_whole_phrases K7_journal_hybrid K17_similar_titles K18_near_titles G1_gaps G3_phase_moves G9_pull_plan R7_render R10_issue_payload S2_parse_markdown M13_schema_deltas J5_missing_reverse K4_hybrid_without_vectors K6_journal_keyword K6_combined K10_rerank P25_block P36_angle J25_resolve A14_ingest_report A17_warnings R8_modes R9_sections R11_context_attachments S14_template S16_snapshot G8_push_targets G15_commit_then_validate G17_link M10_refreshed M12_suffix_plan M13_applied M15_pruned W8_retention V1_bfs".split()
NAMES = sorted(registry.oracle_sql()) if os.environ.get("QUILLGRAPH_ALL") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == columns
    assert got == sorted(repr([plain(r[order.index(c)]) for c in columns]) for r in cursor.fetchall())


def test_near_titles_count_characters(spark, tmp_path):
    """Edits are of characters in both engines, whatever their bytes."""
    titles = ["Straße", "Strasse", "日本語の本", "日本语的本", "日本", "中国", "naïve", "naive", "nave", "übermäßig", "ubermassig", "ubermaßig", "a", "é", ""]
    rows = [(i, t, "de", "x") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["K18_near_titles"](spark, str(tmp_path)).select("a", "b", "distance").collect()
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.execute(f"select a, b, distance from ({registry.oracle_sql()['K18_near_titles']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {("0", "1", 2), ("2", "3", 2), ("4", "5", 2), ("6", "7", 1), ("11", "9", 2)} <= set(want)
