"""Pipeline stages on empty and on odd tables."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_an_empty_and_an_odd_table(spark, sf, tmp_path):
    prose = "the quick brown fox and the lazy dog went to the river with a friend, and number {} was there as well on that day of spring."
    rows = [(k, prose.format(f"n{k} z{k * 7} q{k * 13} w{k * 17} u{k * 29} t{k * 31}"), "en", f"s{k % 3}", 100) for k in range(30)]
    rows += [(3, rows[3][1], "en", "s0", 100), (None, prose.format("x1 x2 x3"), None, None, None), (40, None, None, None, None), (41, "", "en", "s1", 0), (42, "word " * 60_000, "en", "s1", 300_000), (43, prose.format("y1 y2 y3"), None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    for start in (odd, odd.limit(0)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.columns == list(corpus_pipeline.COLUMNS) + (["shard"] if name == "sharding" else [])
            path = f"{tmp_path}/{len(docs.columns)}-{start is odd}-{k}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert set(map(repr, docs.select(*corpus_pipeline.COLUMNS).collect())) <= set(map(repr, odd.collect()))
        n = docs.count()
        assert (n >= 25) if start is odd else n == 0
