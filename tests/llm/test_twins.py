"""Queries of this subpackage against their SQL twins on a whole small table."""

import duckdb
import pytest

from quillgraph.llm import queries


@pytest.mark.parametrize("name", ["op3_url_filter", "op7_mixing", "op7_mixing_budget", "op8_chat_format", "op11_collocations", "op12_centroids"])
def test_same_rows(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    order = [x[0] for x in cursor.description]
    df = queries.queries()[name](spark, sf)
    own = [n for n in order if n in df.columns]
    assert set(own) == set(order)
    assert sorted(repr([r[n] for n in order]) for r in df.collect()) == sorted(map(repr, map(list, cursor.fetchall())))
