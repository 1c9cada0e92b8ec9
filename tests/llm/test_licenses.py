"""Licence texts that are wrapped, embedded or whole, and the twin of the query."""

import textwrap

import duckdb
import pytest

from quillgraph.llm import license, queries

MIT, BSD, APACHE = (next(t for n, t in license.TEXTS if n == name) for name in ("MIT", "BSD-3-Clause", "Apache-2.0"))
PROSE = "The river rose in the night and by the morning the lower fields of the valley were under water. "


def test_passages(spark):
    whole = " ".join(MIT.split())
    cases = {
        1: (PROSE * 3 + "\n" + whole + "\n" + PROSE, "MIT"),
        2: ("Copyright (c) 2020 A. Person\n\n" + "\n".join(textwrap.wrap(whole, 60)), "MIT"),
        3: ("\n".join("# " + x for x in textwrap.wrap(" ".join(APACHE.split()), 40)) + "\nimport os", "Apache-2.0"),
        4: (PROSE + "This book is Licensed under CC BY 4.0 in all lands. " + PROSE, "CC-BY-4.0"),
        5: ("notes\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the\nGNU General Public License\n", "GPL-3.0"),
        6: ("\n".join(textwrap.wrap(" ".join(BSD.split()).replace("copyright holder", "University of Nowhere"), 50)), "BSD-3-Clause"),
        7: (PROSE * 50, None),
        8: ("Permission is hereby granted to the reader to enjoy the software of life, free of charge and without restriction. " + PROSE, None),
        9: (None, None),
        10: ("of the " * 60_000, None),
        11: (PROSE * 3000 + whole, "MIT"),
    }
    d = spark.createDataFrame([(k, t, 0) for k, (t, _) in cases.items()], "doc_id long, text string, license int")
    got = {r.id: r for r in license.scan(d).collect()}
    assert {k: r.license for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert got[1].dice == 1.0 and got[1].n_passages >= 1 and got[9].n_passages == 0
    assert license.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_word_bound_loses_nothing(threshold):
    """Any set of pairs that is large enough has at least as many words as the bound says."""
    import random

    rng = random.Random(3)
    for _, t in (*license.TEMPLATES, *license.TEXTS):
        pairs = license.bigrams(t)
        bound = license.least_words(pairs, threshold)
        for _ in range(30):
            some = rng.sample(pairs, min(len(pairs), int(len(pairs) * threshold / (2 - threshold) + 0.999)))
            assert len({w for p in some for w in p.split()}) >= bound


def test_the_query_equals_its_sql(spark, sf):
    c = duckdb.connect()
    extra = [(10**9 + k, "\n".join(textwrap.wrap(PROSE + " ".join(t.split()) + " " + PROSE, 50 + k))) for k, (_, t) in enumerate(license.TEXTS)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    c.register("documents", docs.toPandas())
    cur = c.execute(queries.oracle_sql()["op6_license_scan"])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    got = license.scan(docs).withColumnRenamed("id", "doc_id")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want and set(names) == set(got.columns)
    assert sum(r[names.index("n_passages")] > 0 for r in want) >= len(extra)
