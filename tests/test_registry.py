"""The driver contract."""

import __spark_entry__


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["kind", "severity", "node_id", "detail"] and df.count() > 0


def test_every_sql_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_runs_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillgraph.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
