"""Search, budgets, text functions and journal operators on small fixtures."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.stem import stems
from quillgraph.operators import journal as J
from quillgraph.operators import search as R
from quillgraph.operators import workflow as W


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_bm25_ranks_the_storage_decision_first(spark):
    docs = spark.createDataFrame([(1, "Session replay", "replay of sessions"), (2, "Storage decision", "storage in object storage"), (3, "Task ingestion", "ingestion pipeline with storage")], "id long, title string, body string")
    q = spark.createDataFrame([(1, ["storage"]), (2, ["replay", "pipeline"]), (3, ["nothing"])], "query_id long, terms array<string>")
    hits = R.bm25(R.corpus(docs, "title", "body"), q).orderBy("query_id", "rank").collect()
    assert [h.id for h in hits if h.query_id == 1][0] == 2 and {h.id for h in hits if h.query_id == 2} == {1, 3} and not [h for h in hits if h.query_id == 3]
    assert R.bm25(R.corpus(docs, "title", "body"), q, every=True).filter("query_id = 2").count() == 0


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in R.nearest(v, q, 2).orderBy("rank").collect()] == [1, 2]
    assert R.nearest(v, q, 4, least=0.5).count() == 2


def test_budgets(spark):
    rows = [(1, k, f"e{k}", "s" * 40, "d" * n) for k, n in enumerate((40, 400, 40), 1)] + [(1, 4, "e4", "t" * 4000, None), (1, 5, "e5", "u", None)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, id string, summary string, detail string")
    got = {r.id: r.detail for r in R.skip_budget(hits, 60).collect()}
    assert set(got) == {"e1", "e2"} and got["e1"] == "d" * 40 and got["e2"].endswith("…") and len(got["e2"]) > 40
    flat = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "query_id long, id long, score double")
    pay = spark.createDataFrame([(1, "x", None, 900), (2, "x", None, 10)], "id long, node_type string, updated timestamp, tokens long")
    assert [r.id for r in R.hybrid(flat, flat, None, pay, F.current_timestamp(), budget=10).collect()] == [1]


def test_title_pairs(spark):
    rows = [(1, "t", "Session Replay Feature"), (2, "t", "session replay feature"), (3, "t", "Session Replay Component"), (4, "t", "Billing Engine"), (5, "u", "Billing Engine"), (6, "t", "Billing Engin"), (7, "t", "ab"), (8, "t", "abcd"), (9, "t", "")]
    n = spark.createDataFrame(rows, "id long, node_type string, title string")
    assert {(r.a, r.b, r.n_a) for r in R.similar_titles(n, 0.6).collect()} == {(1, 3, 2)}
    assert {(r.a, r.b, r.distance) for r in R.near_titles(n).collect()} == {(4, 6, 1), (7, 8, 2), (7, 9, 2)}


def test_text_functions(spark):
    assert one(spark, T.title(F.col("b"), F.lit("id")), b="x\n# # Deep title \nz") == "Deep title"
    assert one(spark, T.entropy(F.col("s")), s="aaaaaa") == 0.0 and one(spark, T.entropy(F.col("s")), s="ababababab") == 1.0
    assert one(spark, F.array_join(T.query_terms(F.col("q")), " OR "), q="hello, world!") == "hello OR world"
    assert one(spark, T.slug(F.col("s")), s="Session Replay") == "session-replay"
    assert one(spark, T.body_section(F.col("b"), "Why"), b="# T\n## Why now\nbecause\n## Next\nno") == "because"
    assert one(spark, T.nearest_kind(F.col("k")), k="decison") == "decision" and one(spark, T.nearest_kind(F.col("k")), k="xyzzyx") is None
    assert one(spark, T.parse_size(F.col("s")), s="200K") == 204800
    for rule, secret in (("aws_access_key", "AKIA" + "A1" * 8), ("github_pat", "ghp_" + "a" * 36), ("private_key_block", "-----BEGIN RSA PRIVATE KEY-----"), ("user_home_path", "/home/alice"), ("db_url_with_password", "postgres://u:p@h/db")):
        assert f"<REDACTED:{rule}>" in one(spark, T.redact(F.col("s"), T.SECRET_RULES), s=f"x {secret} y")
    assert one(spark, T.redact(F.col("s"), T.SECRET_RULES), s="plain prose") == "plain prose"


def test_journal_statistics(spark):
    t = datetime(2024, 1, 31)
    rows = [("a", "finding", t), ("b", "finding", t - timedelta(days=1)), ("c", "decision", t), ("d", "dead_end", t)]
    e = spark.createDataFrame([(i, k, x, "ag", "s1", False, False, ["hot.rs", "hot.rs"] if i != "d" else ["cold.rs"], f"summary {k}") for i, k, x in rows], "id string, kind string, ts timestamp, agent string, session_id string, provisional boolean, final boolean, files array<string>, summary string")
    assert J.totals(e).first().dead_end_ratio == 0.5 and J.totals(e.filter("kind = 'finding'")).first().dead_end_ratio is None
    assert [(r.value, r.n) for r in J.top_values(e, "files", 2).collect()] == [("hot.rs", 3), ("cold.rs", 1)]
    week = J.activity(e, F.lit("2024-01-31").cast("timestamp"), 7).collect()
    assert len(week) == 8 and sum(r.n for r in week) == 4
    assert J.distinct_summaries(e, [], [F.desc("ts"), F.col("id")]).count() == 3


def test_retention(spark):
    s = spark.createDataFrame([(f"k{k}", 100 * (1 + (k == 4) * 9), k, k == 0) for k in range(8)], "snapshot_key string, bytes long, modified long, pinned boolean")
    got = {r.snapshot_key: r.reason for r in W.retention(s, 2, 600).collect()}
    assert got == {"k0": "pinned", "k7": "recent", "k6": "recent", "k5": "under_cap", "k4": "evict", "k3": "under_cap", "k2": "under_cap", "k1": "evict"}


def test_porter_stems(spark):
    want = "caresses caress|ponies poni|cats cat|feed feed|agreed agre|motoring motor|sing sing|conflated conflat|troubled troubl|hopping hop|falling fall|filing file|happy happi|sky sky|relational relat|rational ration|digitizer digit|decisiveness decis|triplicate triplic|electrical electr|goodness good|revival reviv|adjustable adjust|replacement replac|adoption adopt|probate probat|rate rate|controll control|roll roll|Éclairs eclair"
    pairs = [p.split() for p in want.split("|")]
    got = {r.id: r.stem for r in stems(spark.createDataFrame([(w, w) for w, _ in pairs], "id string, body string")).collect()}
    assert got == {w: s for w, s in pairs}


def test_prefixes_are_counted_by_document(spark):
    """No exchange deals a row a term, and a term shorter than a prefix does not match it."""
    docs = spark.createDataFrame([(1, ["abc", "ab", "abd", "abc"]), (2, ["a", "xyz"])], "id int, terms array<string>")
    out = R.prefixes(docs, spark.createDataFrame([(7, "abc"), (8, "ab"), (9, "ab"), (10, "a")], "query_id int, prefix string"))
    assert sorted(map(tuple, out.collect())) == [(7, 1, 2), (8, 1, 4), (9, 1, 4), (10, 1, 4), (10, 2, 1)]
    assert "hashpartitioning(term" not in out._jdf.queryExecution().executedPlan().toString()


def test_vectors_that_serve_many_rows(spark, monkeypatch):
    """Contents meet once and give the rows that all rows would give; few similarities are held at a time."""
    r = random.Random(3)
    vectors = [(c, [float(r.randint(-1, 1)) for _ in range(3)]) for c in range(40)] + [(40, None), (41, [1.0])]
    uses = [(n, r.randint(0, 41)) for n in range(400)]
    v = spark.createDataFrame(vectors, "content long, embedding array<float>")
    u = spark.createDataFrame(uses, "id long, content long")
    q = u.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "content")
    rows = lambda df: sorted((x.query_id, x.id, x.rank, round(x.similarity, 9)) for x in df.collect())
    want = rows(R.nearest(u.join(v, "content"), q.join(v, "content"), 12))
    monkeypatch.setattr(R, "CELLS", 50)
    met = []
    monkeypatch.setattr(R, "nearest", lambda a, b, k, plain=R.nearest: met.append((a.count(), b.count())) or plain(a, b, k))
    assert rows(R.nearest_uses(v, u, q, 12)) == want and len(want) > 300
    assert met[0][0] <= 42 and met[0][1] <= 42


def test_title_pairs_are_ruled_out_before_titles_are_sent(spark):
    """Titles that share a rare word but little else do not meet; overlap equals the plain count, repeats and long titles too."""
    r = random.Random(7)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 8, 20, 60, 500]))] for _ in range(40)]
    titles = [" ".join(w if r.random() > 0.1 else f"x{r.randint(0, 9)}" for w in t) for t in base for _ in range(3)]
    titles += ["x x x x", "x", "x y y y y", "y x", *[f"shared u{n} v{n} t{n}" for n in range(30)]]
    rows = [(n, "t", t) for n, t in enumerate(titles)]
    want, seen = set(), {}
    for n, _, t in rows:
        seen.setdefault(t, n)
    words = {n: t.split() for t, n in seen.items()}
    for a in words:
        for b in words:
            same = round(sum(w in words[b] for w in words[a]) / max(len(words[a]), len(words[b])), 6)
            if a < b and same >= 0.8:
                want.add((a, b, same))
    df = R.similar_titles(spark.createDataFrame(rows, "id long, node_type string, title string"))
    assert {(x.a, x.b, x.similarity) for x in df.collect()} == want and len(want) > 20
    signed = R._signed(spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "rep long, w array<string>")).orderBy("rep").collect()
    bits = [sum(bin(x & (1 << 64) - 1).count("1") for x in s.bits) for s in signed]
    assert bits in ([2, 0], [1, 0]) and "bit_count" in df._jdf.queryExecution().analyzed().toString()


def test_phrases_in_tasks_equal_brute_force(spark, monkeypatch):
    """All occurrences count, also overlapping ones and phrases of many words; several passes find the same; no text is dealt."""
    r = random.Random(3)
    docs = [(i, [r.choice("abc") for _ in range(r.randint(0, 40))]) for i in range(60)] + [(100, ["a"] * 50), (101, []), (102, [*"xyz"] * 30)]
    asked = [(q, docs[q][1][: r.randint(1, 40)]) for q in range(0, 60, 3)] + [(200 + k, list(p)) for k, p in enumerate(("a", "aa", "aaaaa", "ab", "ab", "zx", "w"))] + [(300, [*"xyz"] * 25), (301, [])]
    want = {(q, i, n) for q, p in asked if p for i, w in docs if (n := sum(w[k : k + len(p)] == p for k in range(len(w))))}
    d, q = spark.createDataFrame(docs, "id long, terms array<string>"), spark.createDataFrame(asked, "query_id long, terms array<string>")
    got = R.phrases(d, q)
    assert "Exchange hashpartitioning(id" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in got.collect()} == want and (201, 100, 49) in want and (300, 102, 6) in want
    monkeypatch.setattr(R, "PHRASE_BYTES", 200)
    monkeypatch.setattr(R.matching, "TOKENS", 30)
    assert {tuple(x) for x in R.phrases(d, q).collect()} == want


def test_title_words_are_ranked_once_each(spark):
    """Repeated words count in a title's prefix as often as they stand; the words that are ranked carry no signature."""
    import random

    r = random.Random(4)
    titles = [" ".join(r.choices("abcdef", [9, 5, 3, 2, 1, 1], k=r.randint(1, 12))) for _ in range(120)] + ["", " "]
    df = spark.createDataFrame([(f"{i:04}", "t", x) for i, x in enumerate(titles)], "id string, node_type string, title string")
    reps = {}
    for i, x in enumerate(titles):
        reps.setdefault(x, f"{i:04}")
    held = [(i, x.split()) for x, i in reps.items() if x.split()]
    want = {(a, b): round(sum(w in y for w in x) / max(len(x), len(y)), 6) for a, x in held for b, y in held if a < b}
    out = R.similar_titles(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "bits" in line] and "sum(k#" in plan
    got = {(x.a, x.b): x.similarity for x in out.collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.8} and len(got) > 20
