"""Sharding, mixing, URL lists, chat formatting, pages and the pipeline."""

import zlib
from collections import Counter, defaultdict
from datetime import datetime

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, htmlpages, kdshard, mixing, queries, urlfilter
from quillgraph.llm.components import components
from tests.llm import brute


def test_sharding_law(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots, load = defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(len(t.encode()) for t in docs.values()) + 16
    assert max(load.values()) - min(load.values()) <= 2 * big


def test_sharding_splits_hot_values(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}", "src", "en", 9, "x") for k in range(3000)] + [(None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, shard string")
    got = kdshard.assign(d, shards=7).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in got]
    assert len(b) == 7 and max(b) < 1.03 * min(b)
    assert kdshard.shard_docs(d, 7).columns == ["doc_id", "text", "source", "lang", "n_chars", "shard"]
    assert kdshard.assign(d.limit(0), shards=4).count() == 0
    assert kdshard.assign(d, target_bytes=20000).select("shard").distinct().count() == -(-sum(b) // 20000)


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k % 50), f"s{k % 7 if k % 3 else 0}", "en" if k % 4 else None, 0) for k in range(4000)] + [(-1, None, None, None, 1), (-1, "", "s1", "de", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, probability int")
    got = mixing.weigh(d, alpha=0.5)
    table = mixing.rake(mixing.tempered(mixing.cells(got), 0.5)).collect()
    for axis in mixing.AXES:
        have, want = defaultdict(float), {}
        for r in table:
            have[r[axis]] += r.weight
            want[r[axis]] = r[f"t_{axis}"]
        assert all(abs(have[v] - want[v]) < 0.02 * want[v] for v in want), axis
    kept = got.filter("kept")
    assert kept.filter("id = -1").count() == 2
    share = kept.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    total, wanted = sum(r.n for r in share), {r.source: r.t_source for r in table}
    for r in share:
        assert abs(r.n / total - wanted[r.source] / sum(wanted.values())) < 0.05
    assert mixing.weigh(d.limit(0)).count() == 0
    assert mixing.mix_docs(d).columns == d.columns


def test_url_list_as_of(spark):
    day = lambda n: datetime(2024, 1, n)
    entries = spark.createDataFrame(
        [("bad.com", "spam", day(5), "add"), ("bad.com", "spam", day(10), "remove"), ("a.bad.com", "adult", day(8), "add"), ("ok.org/x", "page", day(1), "add"), (None, "z", day(1), "add"), ("late.com", "l", None, "add"), ("tie.com", "t", day(2), "add"), ("tie.com", "t", day(2), "remove")],
        "value string, category string, at timestamp, action string",
    )
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/p", day(4)), (2, "http://A.bad.com:80/p?q", day(5)), (3, "https://u@a.bad.com", day(9)), (4, "http://a.bad.com/", day(10)), (5, "http://b.bad.com/", day(10)), (6, "http://ok.org/x/?q#f", day(2)), (7, "http://ok.org/y", day(2)), (8, None, day(2)), (9, "http://bad.com", None), (10, "http://notbad.com/", day(6)), (11, "http://tie.com", day(3)), (2, "http://A.bad.com:80/p?q", day(5))],
        "page_id long, url string, fetched timestamp",
    )
    got = defaultdict(list)
    for r in urlfilter.judge(captures, entries).collect():
        got[r.id].append(r.value)
    assert got == {1: [None], 2: ["bad.com"] * 2, 3: ["a.bad.com"], 4: ["a.bad.com"], 5: [None], 6: ["ok.org/x"], 7: [None], 8: [None], 9: [None], 10: [None], 11: [None]}
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
    assert urlfilter.judge(captures, entries.limit(0)).filter("listed").count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "<|end|>\n\\<|turn|>é😀"), (1, 0, "user", "a\nb"), (1, 2, None, None), (1, 3, "assistant", ""), (1, 4, "assistant", "x" * 50000), (2, None, "as\nsist\\ant", "q"), (2, 0, "assistant", " lead"), (2, 0, "assistant", " lead"), (None, 0, "assistant", "n")]
    c = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, tokens string")
    formatted = chat.format_conversations(c)
    for r in formatted.collect():
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id), key=lambda x: x[:2])
        assert chat.parse(r.text) == [(x[2], x[3]) for x in own]
        assert "".join(chat.unescape(r.text[s.begin : s.end]) for s in r.loss_spans) == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.loss_tokens == sorted(set(r.loss_tokens))
    assert chat.digests(formatted.limit(0)).count() == 0
    assert queries.op8_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first().loss_sha256 == brute.sha(r"\### Assistant: </turn> ok")


HEAD = "<html><head><title>T</title><style>x{}</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"),
        (HEAD + "<article><header><h1>Big &amp; new</h1></header><p>One<b>two</b> three<br>four</p><div class='ad'>buy</div><aside>side</aside><p>five</p><section id='comments'><p>me too</p></section></article><footer>f</footer>", "Big & new Onetwo three four five"),
        (HEAD + "<div class='cookie-notice'>ok?</div><main><p>a<p>b<script>if (a < b) {}</script><form><input>x</form></main><footer>f", "a b"),
        ("<!-- c --><p title='a > b'>x&nbsp;y&#33;</p><ul class=\"menu\"><li>m</li></ul><p>z", "x y! z"),
    ],
)
def test_page_lines(html, want):
    assert htmlpages.main_text(htmlpages.lines(html), None) == want


def test_pages_are_differenced(spark):
    page = lambda body: f"<body><div>Acme daily</div><div>Section A</div>{body}<div>All about Acme</div></body>"
    rows = [(1, "http://h.com/a", page("<p>first story</p>"), 0), (2, "http://h.com/b", page("<p>second story</p>"), 0), (3, "http://alone.com/", page("<p>third</p>"), 0), (4, None, None, 0), (5, "http://h.com/b", page("<p>second story</p>"), 0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int").coalesce(1)
    got = {r.page_id: r.text for r in htmlpages.extract(d).coalesce(1).collect()}
    assert got[1] == "first story" and got[2] == "second story" and got[4] == ""
    assert got[3] == "Acme daily Section A third All about Acme" and got[5] == "Acme daily Section A second story All about Acme"
    assert htmlpages.extract(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 100), (7, 7), (None, 3)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[103] == got[101] == 100 and all(got[500 + k] == 500 for k in range(60))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "sharding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert all(after[i] == before[i] for i in after)
        if name == "quality_rules":
            assert {i for i in before if brute.counts(before[i].text)[5]} <= gone
        if name == "near_dedup":
            assert set(after) == {c for _, c in brute.classes([(i, r.text) for i, r in before.items()]).values()}
        if name == "decontamination":
            assert gone == {i for i, r in before.items() if brute.contamination(r.text, bench)[3]}
        if name == "mixing":
            assert set(after) == raked(before)
    assert gone == set()
    load = Counter()
    for r in after.values():
        load[r.shard] += len(r.text.encode()) + 16
    assert set(load) <= set(range(40))
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(after)


def raked(rows):
    """The documents that a plain IPF keeps, scaled to the token budget cell by cell."""
    import hashlib
    import re

    def topic(t):
        own = set(re.split("[^a-z]+", t.translate(brute.LOWER)))
        best = max(mixing.TOPICS, key=lambda name: (len(own & set(mixing.TOPICS[name])), -list(mixing.TOPICS).index(name)))
        return best if own & set(mixing.TOPICS[best]) else mixing.GENERAL

    n = {i: len(brute.SPACED.findall(r.text)) for i, r in rows.items()}
    cell = {i: (r.source, r.lang, topic(r.text)) for i, r in rows.items()}
    tokens = Counter()
    for i in rows:
        tokens[cell[i]] += n[i]
    weight, total = {c: float(v) for c, v in tokens.items()}, sum(tokens.values())
    targets = []
    for a in range(3):
        own = Counter()
        for c, v in tokens.items():
            own[c[a]] += v
        whole = sum(v**corpus_pipeline.ALPHA for v in own.values())
        targets.append({x: v**corpus_pipeline.ALPHA / whole * total for x, v in own.items()})
    for _ in range(200):
        for a in range(3):
            have = defaultdict(float)
            for c, w in weight.items():
                have[c[a]] += w
            weight = {c: w * targets[a][c[a]] / have[c[a]] for c, w in weight.items()}
    factor = {c: weight[c] / tokens[c] for c in weight}
    low, high = 0.0, 1e9  # the scale at which the expected tokens are the budget, by halving
    for _ in range(200):
        c = (low + high) / 2
        kept = sum(tokens[x] * min(1.0, c * factor[x]) for x in factor)
        low, high = (c, high) if kept < corpus_pipeline.BUDGET * total else (low, c)
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52
    return {i for i in rows if u(i) < min(1.0, high * factor[cell[i]])}
