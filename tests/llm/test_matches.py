"""Longest verbatim matches and their locations against a plain search."""

import random

import pytest

from quillgraph.llm import decontam
from tests.llm import brute


def plain(text, items):
    """{item: (words, first in the document, first in the item)} of the longest matches of 13 words (or a whole short item)."""
    w = brute.PLAIN.findall((text or "").translate(brute.LOWER))
    out = {}
    for name, t in items:
        v = brute.PLAIN.findall((t or "").translate(brute.LOWER))
        n = min(13, len(v))
        for i in range(len(w)) if n else ():
            for j in range(len(v) - n + 1):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                if k >= n:
                    out[str(name)] = min(out.get(str(name), (0, 0, 0)), (-k, i, j))
    return {name: (-k, i, j) for name, (k, i, j) in out.items()}


@pytest.mark.parametrize(("block", "pairs", "item_bytes"), [(1 << 20, 1 << 21, 1 << 21), (300, 50, 1500)])
def test_longest_matches(spark, monkeypatch, block, pairs, item_bytes):
    rng = random.Random(8)
    letters = lambda n: [rng.choice("abc") for _ in range(n)]
    items = [(k, " ".join(letters(rng.choice([3, 13, 20, 60])))) for k in range(25)] + [(3, " ".join(letters(40))), (50, ""), (51, None)]
    docs = []
    for k in range(60):
        w = letters(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items)[1]
            if v:
                v = v.split()
                a = rng.randrange(len(v))
                at = rng.randint(0, len(w))
                w[at:at] = v[a : a + rng.randint(1, 50)]
        docs.append((k, " ".join(w), "clash"))
    docs += [(60, None, "x"), (61, "", "x"), (5, docs[5][1], "x")]
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    d = spark.createDataFrame(docs, "doc_id long, body string, matches string")
    got = decontam.annotate(d, spark.createDataFrame(items, "item_id long, text string"), "body", item_bytes=item_bytes, block_words=block).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(dict((i, t) for i, t, _ in docs)[r.row.doc_id], items)
        assert {m["item"]: (m["length"], m["start"], m["item_start"]) for m in r.matches} == want
        assert r.longest == max((k for k, _, _ in want.values()), default=0) and sorted(r["items"]) == sorted(want)
    assert decontam.clean(d.limit(0), spark.createDataFrame(items, "item_id long, text string"), "body").columns == d.columns


def test_the_query_equals_its_sql(spark, sf):
    import duckdb

    from quillgraph.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = c.execute(queries.oracle_sql()["op4_decontamination"])
    names = [x[0] for x in rows.description]
    want = sorted(rows.fetchall())
    df = queries.op4_decontamination(spark, sf)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want and set(df.columns) == set(names)
    assert any(r[names.index("longest_match")] > 13 for r in want)
