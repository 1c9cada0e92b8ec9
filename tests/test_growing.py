"""Growing journals, idempotent batches and stored tables, driven in steps."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import embed as E
from quillgraph.sources import tables as ST
from quillgraph.streaming import growing as GR
from quillgraph.streaming import journal as SJ


def line(k, **more):
    return json.dumps({"v": 1, "id": f"j{k}", "ts": "2026-04-28T12:00:00Z", "agent": "a", "kind": "plan", "summary": f"entry number {k}, sufficiently long", "session_id": "x", **more}) + "\n"


def add(path, text):
    path.parent.mkdir(exist_ok=True)
    with path.open("a") as f:
        f.write(text)


def refresh(spark, tmp_path, size=GR.RANGE):
    """One run of ingest; (rows, corrupt lines) of the whole table after it."""
    SJ.ingest(GR.tail(spark, str(tmp_path / "in"), size), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()), spark.read.parquet(str(tmp_path / "bad")).filter("_corrupt is not null").count()


def test_a_partial_line_waits_for_its_newline(spark, tmp_path):
    f = tmp_path / "in" / "1.jsonl"
    add(f, line(1) + "\n" + "{broken\n" + line(2)[:-1])
    assert refresh(spark, tmp_path) == (["j1"], 1)
    add(f, "\n")
    add(tmp_path / "in" / "2.jsonl", line(3))
    add(tmp_path / "in" / "notes.txt", line(9))
    assert refresh(spark, tmp_path) == (["j1", "j2", "j3"], 1)


def test_a_shorter_file_is_read_again(spark, tmp_path):
    f = tmp_path / "in" / "1.jsonl"
    add(f, line(1) + line(2) + line(3))
    assert refresh(spark, tmp_path)[0] == ["j1", "j2", "j3"]
    f.write_text(line(4))
    assert refresh(spark, tmp_path)[0] == ["j1", "j2", "j3", "j4"]
    f.unlink()
    add(tmp_path / "in" / "2.jsonl", line(1) + line(5))
    assert refresh(spark, tmp_path)[0] == ["j1", "j2", "j3", "j4", "j5"]


@pytest.mark.parametrize("size", [1, 7, 100, 1000])
def test_ranges_hold_each_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(GR, "LOOK", 5)
    texts = ["a", "", "  ", "é" * 30, "x" * 300, "b"] * 5
    (tmp_path / "1.jsonl").write_text("".join(t + "\n" for t in texts) + "part")
    reader = GR.GrowingReader(str(tmp_path), "*.jsonl", size)
    end = reader.latestOffset()
    got = [r["value"] for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for r in b.to_pylist()]
    assert got == [t for t in texts if t.strip()]
    assert reader.partitions(end, reader.latestOffset()) == []
    assert GR.GrowingReader(str(tmp_path / "none"), "*", 1).latestOffset() == {}


def test_a_batch_reads_only_the_buckets_of_its_ids(spark, tmp_path):
    add(tmp_path / "in" / "1.jsonl", "".join(line(k) for k in range(100)))
    refresh(spark, tmp_path)
    one = spark.createDataFrame([("j5",)], "id string")
    there = ST.known(spark, str(tmp_path / "out"), "id", one)
    assert {r.id for r in there.collect()} >= {"j5"} and there.count() < 30
    assert "PartitionFilters: [isnotnull(bucket" in there._jdf.queryExecution().toString() or "bucket#" in there._jdf.queryExecution().toString()
    assert ST.known(spark, str(tmp_path / "nothing"), "id", one) is None


class Counted(E.HashedWords):
    pass


def test_known_contents_are_not_embedded_again(spark, tmp_path):
    run = lambda: SJ.embed_new(GR.tail(spark, str(tmp_path / "in")), str(tmp_path / "v"), str(tmp_path / "cp")).awaitTermination(120)
    add(tmp_path / "in" / "1.jsonl", line(1, kind="finding", summary="one content") + line(2, kind="finding", summary="two contents"))
    run()
    add(tmp_path / "in" / "1.jsonl", line(3, kind="finding", summary="one content") + line(4, kind="finding", summary="three contents"))
    run()
    got = [r.content_hash for r in spark.read.parquet(str(tmp_path / "v")).collect()]
    assert len(got) == len(set(got)) == 3


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, body string").withColumn("content_hash", F.sha2("body", 256))


def test_a_stored_index_follows_its_source(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def derive(df):
        calls.append(df.count())
        return df.withColumn("n", F.length("body"))

    go = lambda rows, schema="1": ST.refresh(spark, path, schema, ["id"], nodes(spark, rows), "content_hash", derive)
    stored = lambda: {r.id: r.n for r in ST.read(spark, path).collect()}
    first = [(f"n{k}", "x" * k) for k in range(20)]
    assert go(first) == {"rebuilt": 1, "added": 20, "changed": 0, "removed": 0, "unchanged": 0} and stored()["n7"] == 7
    before = ST.manifest(spark, path)
    assert go(first)["unchanged"] == 20 and ST.manifest(spark, path) == before and calls == [20]
    second = [*first[1:-1], ("n19", "yy"), ("new", None)]
    assert go(second) == {"rebuilt": 0, "added": 1, "changed": 1, "removed": 1, "unchanged": 18} and calls == [20, 2]
    assert stored() == {f"n{k}": k for k in range(1, 19)} | {"n19": 2, "new": None}
    assert go(second, "2")["rebuilt"] == 1 and ST.current(spark, path, "1") is None and ST.current(spark, path, "2").rows == 20


def test_a_table_that_cannot_be_read_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    go = lambda: ST.refresh(spark, path, "1", ["id"], nodes(spark, [("a", "b")]), "content_hash")["rebuilt"]
    assert (go(), go()) == (1, 0)
    newest = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("manifest"))[-1]
    (tmp_path / "t" / "manifest-000000000002.json").write_text("{half a manif")
    assert ST.manifest(spark, path) is None and go() == 1 and go() == 0
    (tmp_path / "t" / "version-000000000009-dead").mkdir()  # a writer that died
    assert ST.manifest(spark, path).rows == 1 and newest.exists()
    assert ST.vacuum(spark, path, keep=1) == 2 and ST.read(spark, path).count() == 1


def test_an_empty_source_is_a_table_too(spark, tmp_path):
    path = str(tmp_path / "t")
    assert ST.refresh(spark, path, "1", ["id"], nodes(spark, []), "content_hash")["added"] == 0
    assert ST.refresh(spark, path, "1", ["id"], nodes(spark, [("a", "b")]), "content_hash")["added"] == 1
