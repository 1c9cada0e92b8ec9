"""The edges view: the rows of its SQL, whichever order the tables lie in."""

import duckdb
import pytest

from quillgraph.sources import bindings as B

COLUMNS = "source_id, edge_idx, target_id, edge_type, valid_from::varchar valid_from, valid_until::varchar valid_until"


@pytest.fixture(scope="module")
def tied(sf, tmp_path_factory):
    """Folders whose lines are tied in order, supplier and number, with the flags in one order and in the other."""
    out = []
    for name, order in (("asc", "l_returnflag"), ("desc", "l_returnflag desc")):
        folder = tmp_path_factory.mktemp(name)
        for t in "region nation customer supplier part orders".split():
            (folder / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        duckdb.execute(f"copy (select * replace (l_orderkey % 40 as l_orderkey, l_suppkey % 3 as l_suppkey, l_partkey % 3 as l_partkey, 1 as l_linenumber) from '{sf}/lineitem.parquet' order by {order}) to '{folder}/lineitem.parquet'")
        out.append(str(folder))
    return out


def rows(spark, folder):
    return sorted(repr(tuple(r)) for r in B.view(spark, folder, "edges").selectExpr(*[c.replace("::varchar", "::string") for c in COLUMNS.split(", ")]).collect())


def test_ties_do_not_decide(spark, tied):
    assert rows(spark, tied[0]) == rows(spark, tied[1])


def test_rows_of_the_sql(spark, sf, tied):
    for folder in (sf, *tied):
        connection = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem".split():
            connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        found = connection.execute(f"{B.oracle('edges')} select {COLUMNS} from edges").fetchall()
        assert rows(spark, folder) == sorted(repr(r) for r in found)



def test_lines_are_read_once(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e = B.view(spark, sf, "edges").select("source_id", "target_id", "edge_type")
    assert plan(e).count("lineitem.parquet") == 1
    assert plan(e.filter("edge_type = 'child_of'")).count("lineitem.parquet") == 0
