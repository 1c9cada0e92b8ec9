"""File sources and streaming, driven in steps."""

import json
import time

from pyspark.sql import functions as F

from quillgraph.sources import markdown as MD
from quillgraph.sources.schema import load_schema
from quillgraph.streaming import journal as SJ

NODE = "---\nid: feat-x\ntype: feature\nstatus: 'active'\ntags: [a, \"b\"]\nedges:\n  - target: p-1\n    type: serves\n    valid_from: 2026-01-02\n  - target: c-1\n    type: uses\n---\n# Session Replay\nbody\n"


def entry(k, day, **more):
    return {"id": f"e{k}", "ts": f"2024-01-{day:02d}T00:00:00Z", "agent": "a", "kind": "finding", "summary": f"a summary that is long enough {k}", "detail": "d", "session_id": "s", **more}


def drop(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def run(frame, tmp_path, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "features").mkdir()
    (tmp_path / "features" / "x.md").write_text(NODE)
    (tmp_path / "features" / "bad.md").write_text("no front matter")
    files = MD.scan(spark, str(tmp_path))
    n = MD.parse(files).collect()
    assert len(n) == 1 and MD.rejected(files).count() == 1
    assert (n[0].id, n[0].status, n[0].tags, n[0].title, n[0].body) == ("feat-x", "active", ["a", "b"], "Session Replay", "# Session Replay\nbody\n")
    assert [(e.target, e.type, str(e.valid_from)) for e in n[0].edges] == [("p-1", "serves", "2026-01-02"), ("c-1", "uses", "None")]
    again = MD.parse(MD.serialise(MD.parse(files)).select(F.lit("f").alias("file_path"), "content")).first()
    assert (again.id, again.edges, again.body) == (n[0].id, n[0].edges, n[0].body)
    assert MD.flatten(MD.parse(files)).count() == 2


def test_schema_file(spark):
    tables = load_schema(spark, '[node_types.task]\ndirectory="tasks"\nrequired_fields=["status"]\n[[edges]]\nsource="task"\ntype="uses"\ntarget="*"\n[edge_types.uses]\nreverse="used_by"\n')
    assert tables["node_types"].first().directory == "tasks" and tables["edge_types"].first().reverse == "used_by"


def test_journal_scan_counts_corrupt_lines(spark, tmp_path):
    drop(tmp_path / "j", "1.jsonl", entry(1, 1), "{broken", entry(2, 1))
    got = MD.journal(spark, str(tmp_path / "j")).cache()
    assert got.filter("_corrupt is not null").count() == 1 and got.filter("id is not null").count() == 2


def test_ingest_is_idempotent(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    drop(folder, "1.jsonl", entry(1, 1), entry(1, 1), "{broken", entry(2, 1, summary="short"), entry(3, 1, detail="key AKIA" + "A1" * 8))
    for step in range(2):
        SJ.ingest(SJ.tail(spark, str(folder)), out, str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
        got = {r.id: r for r in spark.read.parquet(out).collect()}
        assert set(got) == ({"e1", "e3"} if step == 0 else {"e1", "e3", "e4"}) and "<REDACTED:aws_access_key>" in got["e3"].detail
        drop(folder, "2.jsonl", entry(1, 2), entry(4, 2))
    assert spark.read.parquet(out).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_windows_and_duplicates(spark, tmp_path):
    folder = tmp_path / "in"
    drop(folder, "1.jsonl", entry(1, 1), entry(1, 1), entry(2, 1), entry(3, 2))
    assert run(SJ.distinct_ids(SJ.tail(spark, str(folder))), tmp_path, "ids").count() == 3
    days = {str(r.day): r.n for r in run(SJ.daily(SJ.tail(spark, str(folder))), tmp_path, "days", "complete").collect()}
    assert days == {"2024-01-01": 3, "2024-01-02": 1}


def test_sessions_close_and_tasks_move(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "worktree string, agent string, id string, ts timestamp, final boolean, status string, updated timestamp"
    rows = lambda *r: [{"worktree": "w", "agent": "a", "id": i, "ts": f"2024-01-01T00:00:0{k}Z", "final": f, "status": t, "updated": f"2024-01-01T00:00:0{k}Z"} for k, (i, f, t) in enumerate(r)]
    folder = tmp_path / "in"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    drop(folder, "1.json", *rows(("e1", False, "x"), ("e2", True, "x")))
    time.sleep(1.1)  # files go in the order of their times
    drop(folder, "2.json", *rows(("e3", False, "x")))
    assert {r.id: r.session_no for r in run(SJ.sessions(source()), tmp_path, "numbers").collect()}["e3"] == 1
    tasks = tmp_path / "tasks"
    folder = tasks
    drop(tasks, "1.json", *rows(("t1", False, "backlog"), ("t1", False, "in_progress"), ("t2", False, "done"), ("t1", False, "in_progress"), ("t1", False, "done")))
    assert [(r.id, r.kind) for r in run(SJ.task_events(source()), tmp_path, "moves").collect()] == [("t1", "plan"), ("t1", "outcome")]


def test_new_entries_are_embedded(spark, tmp_path):
    drop(tmp_path / "in", "1.jsonl", entry(1, 1), entry(2, 1, summary="another summary, long enough to be kept"), entry(3, 1, kind="plan"))
    SJ.embed_new(SJ.tail(spark, str(tmp_path / "in")), str(tmp_path / "v"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "v")).collect()
    assert len(got) == 2 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got)
