"""Sessions as files."""

import json

from pyspark.sql import functions as F

from quillgraph.sources import sessions as SS

A, B, C, D = "20260320-0a1b2c3d-101500", "20260321-0a1b2c3d-091500", "20260322-0a1b2c3d-080000", "20260322-ffffffff-080000"


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def meta(session, agent="codex", **more):
    return {"v": 1, "session_id": session, "created_utc": "2026-03-20T10:15:00Z", "agent": agent, "worktree_hash": session[9:17], "repo_root": "/w", **more}


def test_open_sessions_and_their_companions(spark, tmp_path):
    folder = tmp_path / "open"
    for s in (A, B, C, D):
        put(folder / f"{s}.jsonl", {"id": f"e-{s}", "summary": "x"})
    (folder / f"{C}.ready").touch()
    (folder / "20260101-00000000-000000.ready").touch()  # its session is archived
    put(folder / f"{A}.meta.json", json.dumps(meta(A), indent=1))
    put(folder / f"{B}.meta.json", meta(B, branch="main"))
    put(folder / f"{C}.meta.json", meta(C))
    put(folder / f"{D}.meta.json", meta(A, agent="other"))
    put(folder / "notes.txt", "no session")
    put(folder / "20260323-0a1b2c3d-000000.meta.json", "{broken")
    files = SS.session_files(spark, str(folder)).cache()
    got = {r.session_id: (r.has_entries, r.has_meta, r.ready) for r in files.collect()}
    assert got == {A: (True, True, False), B: (True, True, False), C: (True, True, True), D: (True, True, False), "20260101-00000000-000000": (False, False, True), "20260323-0a1b2c3d-000000": (False, True, False)}
    assert tuple(SS.session_counts(files).first()) == (3, 1)
    m = SS.session_meta(spark, str(folder)).cache()
    assert {r.session_id: r.problem for r in m.collect()} == {A: None, B: None, C: None, D: "mismatch", "20260323-0a1b2c3d-000000": "corrupt"}
    assert m.filter(F.col("session_id") == B).first().branch == "main"
    assert [tuple(r) for r in SS.resumable(files, m).collect()] == [("0a1b2c3d", "codex", B)]
    assert {r.id: r.ready for r in SS.open_entries(spark, str(folder), files).collect()} == {f"e-{A}": False, f"e-{B}": False, f"e-{C}": True, f"e-{D}": False}


def test_archive_is_read_by_its_layout(spark, tmp_path):
    root = tmp_path / "archive"
    put(root / "2026/03/20" / A / "entries.jsonl", {"id": "e1"}, "{broken", {"id": "e2"})
    put(root / "2026/03/20" / A / "meta.json", meta(A))
    put(root / "2026/03/21" / B / "meta.json", meta(B))
    put(root / "2026/03/23" / C / "entries.jsonl", {"id": "e3"})
    put(root / "2026/03/22" / "no-session" / "entries.jsonl", {"id": "e4"})
    put(root / "loose" / "entries.jsonl", {"id": "e5"})
    files = SS.archived_files(spark, str(tmp_path)).cache()
    assert {r.session_id: r.problem for r in files.collect()} == {A: None, B: "no entries", C: "misplaced", "no-session": "misplaced"}
    rows = SS.archived_entries(spark, str(tmp_path), files).collect()
    assert {(r.id, r.archived_session) for r in rows} == {("e1", A), ("e2", A), (None, A)} and [r._corrupt for r in rows if r.id is None] == ["{broken"]
    known = files.filter("problem is null").select(*SS.STAMP)
    known = spark.createDataFrame(known.collect(), known.schema)
    files.unpersist()  # a later scan of the folder would be answered by it
    assert SS.archived_files(spark, str(tmp_path), known).filter("problem is null").count() == 0
    put(root / "2026/03/22" / D / "entries.jsonl", {"id": "e6"})
    put(root / "2026/03/20" / A / "entries.jsonl", {"id": "e1"}, {"id": "e2"}, {"id": "e7"}, {"id": "e8"})
    again = SS.archived_files(spark, str(tmp_path), known)
    assert {r.session_id for r in again.filter("problem is null").collect()} == {A, D}
    assert {r.id for r in SS.archived_entries(spark, str(tmp_path), again).collect()} == {"e1", "e2", "e6", "e7", "e8"}


def test_empty_folders(spark, tmp_path):
    (tmp_path / "open").mkdir()
    files = SS.session_files(spark, str(tmp_path / "open"))
    assert files.count() == 0 and tuple(SS.session_counts(files).first()) == (0, 0)
    assert SS.archived_files(spark, str(tmp_path)).count() == 0 and SS.session_meta(spark, str(tmp_path)).count() == 0
