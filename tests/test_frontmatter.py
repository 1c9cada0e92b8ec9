"""Front matter as YAML, hostile values written and read back."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import frontmatter as Y
from quillgraph.sources import markdown as MD

READ = [
    ("a: b\nc: 'd: e'\nf: \"g\\n\\u00e9 # h\" # i\n", {"a": "b", "c": "d: e", "f": "g\né # h"}),
    ("a: {b: c, d: [e, 'f,g', {h: i}]}\n", {"a": {"b": "c", "d": ["e", "f,g", {"h": "i"}]}}),
    ("a:\n- b\n- c: d\n  e: f\n-\n  - g\n  -\n-   - h\n    - i\nj: ~\nk:\n", {"a": ["b", {"c": "d", "e": "f"}, ["g", None], ["h", "i"]], "j": None, "k": None}),
    ("a: |\n  x\n   y\n\n  z\nb: >-\n  p\n  q\n\n  r\nc: |+\n  s\n\nd: >\n  t\n    u\n  v\n", {"a": "x\n y\n\nz\n", "b": "p q\nr", "c": "s\n\n", "d": "t\n  u\nv\n"}),
    ("a: one\n  two\n\n  three # no\nb: 'x\n  y\n\n  z'\n# c\n", {"a": "one two\nthree", "b": "x y\nz"}),
    ("a: [b, # c\n  d,\n  \"e\n  f\"]\nurl: http://x:80/#y\n", {"a": ["b", "d", "e f"], "url": "http://x:80/#y"}),
    ("\"a b\": ''\n'c''d' : e\nf: [ ]\ng: {}\n", {"a b": "", "c'd": "e", "f": [], "g": {}}),
    ("- foo\n bar\n- |\n x\n", ["foo bar", "x\n"]),
    ("a: b \r\nc: d\r\n", {"a": "b", "c": "d"}),
    ("# nothing", None),
]
MALFORMED = ["[invalid yaml", "a: b\na: c", "a: 'b", "a: b: c", "a: *x", "a: [b}", "\ta: b", 'a: "\\q"', 'a: "\\ud800"', "  a: b\n c: d", "[" * 100_000, "a: b\n  c: d", "a: 'b' c"]


@pytest.mark.parametrize("text,want", READ)
def test_yaml_is_read(text, want):
    assert Y.load(text) == want


@pytest.mark.parametrize("text", MALFORMED, ids=range(len(MALFORMED)))
def test_malformed_texts_are_told(text):
    with pytest.raises(Y.Malformed):
        Y.load(text)


def test_nodes_need_their_fields():
    assert Y.node("id: a\ntype: b\nextra: {x: 1}")["problem"] is None
    for text in ("type: b", "id: a", "id: a\ntype: b\ntags: c", "id: a\ntype: b\nedges: [{target: c}]", "id: a\ntype: b\nedges: [{target: c, type: d, valid_from: 2026-13-01}]", "id: a\ntype: b\nupdated: 2026-01-01T00:00:00", "id: [a]\ntype: b", "a", ""):
        assert Y.node(text)["problem"]


VALUES = ["plain", "a: b", "a #b", "#", "- x", "'", '"', "it's", "null", "~", "", " lead", "trail ", "two\nlines", "tab\tin", "\\", "\\n", "a\r\nb", "true", "123", "2026-01-01", "[x]", "{", "a,b", "é: ü", "x:", "---", "\n---\n", "a\u2028b", "\x85", "&a", "*a", "!a", "%", "@", "`", "? a", "0x1f", "日本 語"]


def test_any_value_survives_writing_and_reading(spark):
    ddl = "id string, node_type string, status string, owner string, created timestamp, updated timestamp, tags array<string>, edges array<struct<target: string, type: string, valid_from: date, valid_until: date, annotation: string>>, body string"
    stamp = F.to_timestamp(F.lit("2026-03-20T14:30:05Z"))
    rows = [(f"n{k}", v, v, v, None, None, [v, "x", v], [(v, v, None, None, v), ("t", "u", None, None, None)], "body\n---\nx") for k, v in enumerate(VALUES)]
    n = spark.createDataFrame(rows, ddl).withColumns({"created": stamp, "updated": stamp})
    n = n.withColumn("edges", F.transform("edges", lambda e: e.withField("valid_from", F.to_date(F.lit("2026-01-02")))))
    back = MD.parse(MD.serialise(n).select(F.concat("id", F.lit(".md")).alias("file_path"), "content"))
    columns = [c for c in n.columns if c != "title"]
    assert sorted(map(repr, back.select(columns).collect())) == sorted(map(repr, n.select(columns).collect()))


def test_flow_edges_comments_and_blocks_reach_the_tables(spark):
    text = "---\nid: n-1 # the id\ntype: feature\ntags:\n- \"a, b\"\n- c\nedges: [{target: p-1, type: serves}, {target: c-1, type: uses, valid_from: 2026-03-20, annotation: 'x: y'}]\nowner: >-\n  al\n  ice\n---\n# Title\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", "---\n[invalid yaml\n---\nbody\n"), ("c.md", "no fence"), ("d.md", None), ("e.md", ""), ("f.md", "---\ntype: x\n---\n")], "file_path string, content string")
    got = MD.parse(files).collect()
    assert [(r.id, r.tags, r.owner, r.title) for r in got] == [("n-1", ["a, b", "c"], "al ice", "Title")]
    assert [(e.target, e.type, str(e.valid_from), e.annotation) for e in got[0].edges] == [("p-1", "serves", "None", None), ("c-1", "uses", "2026-03-20", "x: y")]
    told = {r.file_path: r.problem for r in MD.rejected(files).collect()}
    assert set(told) == {"b.md", "c.md", "d.md", "e.md", "f.md"} and told["f.md"] == "no id" and told["c.md"] == "no front matter"


def test_a_text_is_read_once(spark):
    files = spark.createDataFrame([("a.md", "---\nid: a\ntype: b\n---\n")], "file_path string, content string")
    plan = MD.parse(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_plain_texts_are_read_in_columns(monkeypatch):
    """Texts of the layout that is written are read without a look at single lines, with the same fields; others, and those with a date that is none, line by line."""
    import random

    import pyarrow as pa

    from quillgraph.functions import frontmatter as FM

    r, text = random.Random(2), pa.string()
    kind = pa.struct([*[(c, text) for c in FM.FIELDS], ("tags", pa.list_(text)), ("edges", pa.list_(pa.struct([(c, text) for c in FM.EDGE_FIELDS]))), ("problem", text)])

    def made(odd):
        word = lambda: r.choice(["a", "x-1", "4-NOT SPECIFIED", "Brand#13", "a  b", "1-URGENT", "nullable", "true", *odd])
        some = lambda line: [line] if r.random() < 0.5 else []
        rows = [f"id: n{r.randrange(9)}", "type: t", *some(f"status: {word()}"), *some("created: 1995-06-17T00:00:00Z"), *some("updated: 2020-01-01T01:02:03+02:00"), *some(f"owner: {word()}"), *some("tags: [a, x-2]")]
        items = [line for _ in range(r.randrange(4)) for line in (f"  - target: p-{r.randrange(99)}", "    type: uses", *some(f"    valid_from: {r.choice(['1995-06-17', *(odd and ['1995-02-30'])])}"), *some("    valid_until: 1999-01-01"), *some(f"    annotation: {word()}"))]
        return "\n".join([*rows, *(["edges:", *items] if items else [])])

    plain, mixed = [made([]) for _ in range(300)], [made(["null", "a: b", "a #b", "'q'", "~", "", "é"]) for _ in range(600)] + [None, "", "id: 1"]
    whole = lambda x: {**dict.fromkeys(f.name for f in kind), **FM.node(x or "")}
    want = [[whole(x) for x in texts] for texts in (plain, mixed)]
    assert {x["problem"] is None for x in want[1]} == {True, False}
    monkeypatch.setattr(FM, "SLICE", 2000)
    assert FM.read(pa.array(mixed), kind).to_pylist() == want[1]
    monkeypatch.setattr(FM, "node", None)
    assert FM.read(pa.array(plain), kind).to_pylist() == want[0]


def test_fences_are_found_with_and_without_the_pattern(spark):
    from quillgraph.sources import markdown as MD

    texts = ["---\nid: a\n---\nbody\n---\nmore", "---\n\n---\n", "---\n---\nx", "--- \nid: a\n---\nb", "---\r\nid: a\r\n---\r\nb", "---\nid: a\n---  \nb", "---\nid: a\n----\nx\n---\nb", "---\nid: a\n---", "---\nid: é\n---\nü\n", "", "x", None, "\n---\nid: a\n---\nb"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "file_path string, content string")
    plain = df.select("file_path", F.regexp_extract("content", MD.FRONT, 1).alias("front"), F.coalesce(F.regexp_extract("content", MD.FRONT, 2), F.lit("")).alias("body"))
    assert sorted(map(repr, MD._read(df).select("file_path", "front", "body").collect())) == sorted(map(repr, plain.collect()))
