import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import catalog, chunking, dedup, generate, hybrid, lexical, paraphrase, vectors

# The compared system's own example and its results.
CORPUS = [
    (1, "Sys-bot uses FastAPI and Ollama for local inference.", "portfolio.md"),
    (2, "CI/CD uses GitHub Actions and Watchtower on EC2 to auto-update containers.", "cicd.md"),
    (3, "Retrieval is hybrid: FAISS for vectors and SQLite FTS5 for lexical.", "architecture.md"),
    (4, "Watchtower monitors GHCR images and pulls latest tags on schedule.", "ops.md"),
    (5, "FAISS index stores embeddings from the BGE model.", "retrieval.md"),
]


@pytest.mark.parametrize("n, count", [(0, 1), (1, 1), (900, 2), (901, 2), (5741, 8)])
def test_chunk_counts(spark, n, count):
    docs = spark.createDataFrame([("x" * n,)], "text string")
    rows = chunking.chunk(docs).orderBy("chunk_idx").collect()
    assert len(rows) == count and [r.chunk for r in rows] == ([("x" * n)[i : i + 900] for i in range(0, n, 780)] or [""])


def test_chunk_edges(spark):
    docs = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r.chunk for r in chunking.chunk(docs, 2, 5).collect()] == ["ab", "bc", "c", ""]
    assert [r.chunk for r in chunking.chunk(docs, 0, 0).collect()] == ["abc", ""]


@pytest.mark.parametrize("n", [900, 901, 780 * 32, 780 * 32 + 1, 780 * 64 + 121, 60_000])
def test_long_texts_chunk_as_short_ones_do(spark, n):
    text = "".join(random.Random(n).choices("abcé ", k=n))
    got = [r.chunk for r in chunking.chunk(spark.createDataFrame([(text,)], "text string")).orderBy("chunk_idx").collect()]
    assert got == [text[i : i + 900] for i in range(0, n, 780)]


def test_chunk_paths(spark):
    df = spark.createDataFrame([("a/b.txt", 0, 1), ("a/b.txt", 1, 2)], "p string, i int, n int")
    assert [r[0] for r in df.select(chunking.chunk_path(F.col("p"), F.col("i"), F.col("n"))).collect()] == ["a/b.txt", "a/b.part002.txt"]


def test_lines_and_sections(spark):
    docs = spark.createDataFrame([("d", "a\n \n b ")], "doc_id string, text string")
    assert [(r.line_no, r.line) for r in chunking.lines(docs).collect()] == [(1, "a"), (3, "b")]
    docs = spark.createDataFrame([("d", "intro\n# One\nx\n## Two\ny")], "doc_id string, text string")
    assert [(r.section, r.heading) for r in chunking.sections(docs).collect()] == [(0, ""), (1, "One"), (2, "Two")]


def test_front_matter(spark):
    df = spark.createDataFrame([("---\ntitle: x\n---\nbody",), ("plain",)], "t string")
    head, body = chunking.front_matter(F.col("t"))
    assert [tuple(r) for r in df.select(head, body).collect()] == [("title: x", "body"), (None, "plain")]


@pytest.mark.parametrize("query, want", [("watchtower", [(4, -0.338570816), (2, -0.309605632)]), ("FAISS", [(5, -0.361092156), (3, -0.328331779)]), ("FastAPI Ollama", [(1, -2.282095913)]), ("uses and", [(1, -0.349470057), (2, -0.309606552)]), ("?!", [])])
def test_bm25_golden(spark, query, want):
    docs = spark.createDataFrame(CORPUS, "id int, text string, source string")
    index = lexical.build(docs, "id", ["id", "text", "source"], stem=True)
    got = lexical.search(index, spark.createDataFrame([(0, query)], "qid int, query string"), 5).orderBy("rank").collect()
    assert [r.id for r in got] == [w[0] for w in want]
    assert np.allclose([r.bm25 for r in got], [w[1] for w in want], atol=1e-8)


def test_phrases(spark):
    """Words that an underscore joins have to stand side by side."""
    docs = spark.createDataFrame([(1, "the foo bar"), (2, "bar foo"), (3, "foo and bar, foo bar")], "id int, text string")
    index = lexical.build(docs, "id", stem=True).saved()
    asked = spark.createDataFrame([(0, "foo_bar"), (1, "foo bar"), (2, "the foo_bar"), (3, "foo__bar foo_and")], "qid int, query string")
    for got in (lexical.matches(index, asked), lexical.search(index, asked, 5)):
        assert sorted((r.qid, r.id) for r in got.collect()) == [(0, 1), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1), (3, 3)]


def _signed(spark, sets):
    return spark.createDataFrame(list(enumerate(map(list, sets))), "id int, items array<bigint>")


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.sample(range(60), 20) for _ in range(8)]
    sets = [set(b) - set(rng.sample(b, rng.randint(0, 4))) | set(rng.sample(range(60, 90), rng.randint(0, 3))) for b in base for _ in range(6)]
    for t in (0.5, 0.8, 0.9):
        rep = [min(j for j in range(len(sets)) if sets[j] == x) for x in sets]
        firsts = sorted(set(rep))
        want = {(i, j) for i, j in itertools.combinations(firsts, 2) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}
        assert {(r.a, r.b) for r in dedup.pairs(_signed(spark, sets), t).collect()} == want | {(r, i) for i, r in enumerate(rep) if i != r}


def test_many_copies_are_one_class(spark):
    """10,000 copies of a set and a near one: links by the first copy, not 50 million pairs."""
    near = list(range(100))
    signs = spark.range(10_000).select("id", F.lit(near).cast("array<bigint>").alias("items")).unionByName(spark.createDataFrame([(20_000, near[:-2] + [500])], "id long, items array<bigint>"))
    assert dedup.pairs(signs, 0.9).count() == 10_000


def test_first_independent(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)} | {(50, 51), (51, 52)}
    kept: set = set()
    for x in sorted({v for e in edges for v in e}):
        if not any((y, x) in edges for y in kept):
            kept.add(x)
    table = spark.createDataFrame(sorted(edges), "a int, b int")
    for few in (dedup.FEW_EDGES, 20):  # in one task, and by rounds before that
        drop = {r.id for r in dedup.first_independent(table, few).collect()}
        assert drop == {v for e in edges for v in e} - kept and 52 not in drop


def test_a_long_chain_settles(spark):
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.id for r in dedup.first_independent(chain).collect()} == set(range(1, 401, 2))
    assert {r.id for r in dedup.first_independent(chain.where("a < 12"), 3).collect()} == set(range(1, 13, 2))
    pairs = spark.createDataFrame([(("a", 1), ("b", 2)), (("b", 2), ("c", 1))], "a struct<p:string,i:int>, b struct<p:string,i:int>")
    assert [tuple(r.id) for r in dedup.first_independent(pairs).collect()] == [("b", 2)]


def test_deduplicate_short_texts(spark):
    long = "one two three four five six seven"
    docs = spark.createDataFrame([(0, "a b"), (1, "c d"), (2, long), (3, long.upper()), (4, None)], "doc_id int, text string")
    assert {r.id: r.kept for r in dedup.deduplicate(docs).collect()} == {0: True, 1: False, 2: True, 3: False, 4: False}
    assert {r.id: r.kept for r in dedup.deduplicate(docs, short_exact=True).collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_semantic_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    x[20:] = x[:20] + rng.normal(scale=0.15, size=(20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(y) for y in v], i % 3) for i, v in enumerate(x)], "vec_id int, embedding array<double>, label int")
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if x[i] @ x[j] >= (0.92 if i % 3 == j % 3 else 0.96)}
    for exact in (True, False):
        got = {(r.a, r.b) for r in dedup.semantic_pairs(df, group="label", exact=exact, block=7).collect()}
        assert got == want and want
    copies = df.where("vec_id = 0").crossJoin(spark.range(100, 400).toDF("n")).select(F.col("n").cast("int").alias("vec_id"), "embedding", "label")
    assert dedup.semantic_pairs(df.unionByName(copies), group="label").count() == len(want) + 300
    assert dedup.semantic_dedup(df.unionByName(copies), group="label").where("kept").count() == 40 - len({b for _, b in want})
    assert dedup.semantic_dedup(df, group="label").where("kept").count() == 40 - len({b for _, b in want})


def test_simhash_distance(spark):
    rng = random.Random(2)  # items are hashes: any 64 bits
    one, other = ([rng.getrandbits(63) for _ in range(100)] for _ in range(2))
    df = _signed(spark, [one, one, other])
    assert {(r.a, r.b, r.distance) for r in dedup.simhash_pairs(df, 3).collect()} == {(0, 1, 0)}


def test_knn(spark, monkeypatch):
    monkeypatch.setattr(vectors, "NUMBERS", 32)  # blocks of two vectors
    x = np.random.default_rng(42).random((30, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id int, embedding array<float>")
    got = vectors.knn(df, df.where("vec_id < 5").withColumnRenamed("vec_id", "qid"), 4).collect()
    sims = x.astype(np.float64) @ x.astype(np.float64).T
    assert {(r.qid, r.rank): r.id for r in got} == {(q, k + 1): int(np.argsort(-sims[q], kind="stable")[k]) for q in range(5) for k in range(4)}
    with pytest.raises(ValueError):
        vectors.check_dimensions(df, df.select(F.slice("embedding", 1, 3).alias("embedding")))


def test_merge_and_rank(spark):
    hits = lambda rows: spark.createDataFrame(rows, "qid int, id string, score double, rank int")
    got = hybrid.merge_and_rank(hits([(0, "a", 2.0, 1), (0, "b", 1.0, 2)]), hits([(0, "c", 0.9, 1), (0, "a", 0.1, 2)])).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("c", 1.0), ("a", 0.5), ("b", 0.0)]
    got = hybrid.merge_and_rank(hits([(0, "a", 2.0, 1)]), hits([(0, "a", 0.5, 1)]), prefix_ids=True).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("lex-a", 0.0), ("vec-a", 0.0)]


def test_sidecar_and_snippets(spark):
    hits = spark.createDataFrame([(0, 0), (0, 7)], "qid int, ordinal int")
    named = hybrid.by_ordinal(hits, spark.createDataFrame([(0, "a:1")], "ordinal int, id string"))
    assert [r.id for r in named.orderBy("ordinal").collect()] == ["a:1", "7"]
    lines = spark.createDataFrame([("a:1", "one")], "line_id string, line string")
    assert {r.id: r.snippet for r in hybrid.snippets(named, lines).collect()} == {"a:1": "one", "7": "(text not found)"}


def test_tables_and_embedder(spark, tmp_path):
    catalog.create(spark, str(tmp_path))
    assert set(catalog.TABLES) == {p.name for p in tmp_path.iterdir()} and not catalog.exists(spark, "nothing_like_this")
    docs = spark.createDataFrame([("ab",), (None,)], "text string")
    got = vectors.embed(docs, lambda: lambda texts: [[len(t), 3.0] for t in texts]).collect()
    assert np.allclose([r.embedding for r in got], [[2 / 13**0.5, 3 / 13**0.5], [0, 1]])


def test_http_embedder(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [len(asked["prompt"]), 4 if asked["model"] == "m" else 0]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = vectors.embed(spark.createDataFrame([("abc",)], "text string"), vectors.http_embedder(f"http://127.0.0.1:{server.server_port}", "m")).first()
    assert np.allclose(got.embedding, [0.6, 0.8])
    server.shutdown()


def test_rerank(spark):
    hits = spark.createDataFrame([(0, "a", "q", "x", 1), (0, "b", "q", "xxx", 2), (0, "c", "q", "xx", 3)], "qid int, id string, query string, text string, rank int")
    got = hybrid.rerank(hits, lambda: lambda pairs: [len(t) for _, t in pairs], 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c"]


def test_resolve_notes_a_missing_document(spark):
    hits = spark.createDataFrame([(0, 1), (0, 9)], "qid int, id int")
    docs = spark.createDataFrame([(1, "t", "s")], "doc_id int, text string, source string")
    assert [(r.text, r.source) for r in hybrid.resolve(hits, docs).orderBy("id").collect()] == [("t", "s"), ("[Missing mapping for 9]", "faiss")]


def test_catalog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, catalog.upsert(old, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError, match="FOREIGN KEY"):
        catalog.check_foreign_key(new, old, "k", "k")
    assert [r.k for r in catalog.cascade(old, new, "k", "k").collect()] == [1]
    assert {r.table: r.n for r in catalog.counts(x=old, y=new.limit(0)).collect()} == {"x": 2, "y": 0}


def test_paraphrase(spark):
    docs = spark.createDataFrame([(0, "keep 5 cats here now"), (1, "two words 7"), (2, "known")], "doc_id int, text string")
    cache = spark.createDataFrame([("x", "y")], "cache_key string, output_text string")

    def client():
        return lambda prompt: "keep 5 cats here today" if "cats" in prompt else "no number"

    done = paraphrase.paraphrase(docs, cache, "plain", client=client)
    assert {r.doc_id: (r.paraphrased, r.origin) for r in done.collect()} == {0: ("keep 5 cats here today", "model"), 1: ("two words 7", "source"), 2: ("known", "source")}
    again = paraphrase.paraphrase(docs, paraphrase.cache_rows(done), "plain")
    assert {r.doc_id: r.origin for r in again.collect()} == {0: "cache", 1: "source", 2: "source"}
    assert paraphrase.stats(done).first().asDict() == {"inputs": 3, "rewritten": 1, "cache_hits": 0, "passed_through": 2}
    assert paraphrase.first_answer(lambda: lambda p: None, lambda: lambda p: p + "!")()("x") == "x!" and paraphrase.first_answer()()("x") is None
    assert paraphrase.completion_text('{"choices": [{"text": " a "}]}') == "a" and paraphrase.completion_text("[]") is None


def test_chat_golden(spark):
    hits = spark.createDataFrame([(0, "A1", 0.88, "portfolio.md", "one", 1), (0, "B2", 0.79, "architecture.md", "two", 2)], "qid int, id string, score double, source string, text string, rank int")
    asked = spark.createDataFrame([(0, "q", None, None, 0.0, None)], f"qid int, message string, history {generate.MESSAGE}, persona string, temperature double, max_tokens int")
    turns = generate.messages(asked, generate.contexts(hits))
    got = generate.echo_answers(turns).first()
    assert got.text == "[ECHO RESPONSE]\nUser question:\nq\n\nContext:\n[A1] (score=0.880) source=portfolio.md\none\n\n---\n\n[B2] (score=0.790) source=architecture.md\ntwo"
    assert got.citations == ["A1", "B2"] and turns.first().temperature == 0.3 and turns.first().max_tokens == 1000

    def client():
        return lambda messages, params: (messages[-1]["role"], {"engine": "x"})

    assert generate.answers(turns, client).first().text == "user"
    assert generate.pick_client({}) is None


def test_prefixes_lose_no_pair_and_few_others_are_weighed(spark, monkeypatch):
    """Pairs are those of brute force with many items late in the order."""
    r = random.Random(5)
    sets = [[*range(r.randint(0, 3)), *(r.randint(0, 40) for _ in range(r.randint(1, 12)))] for _ in range(150)]
    sets = [sorted(set(s)) for s in sets]
    sets += [sorted({*s[:-1], 99}) for s in sets[:60]]
    signs = spark.createDataFrame(list(enumerate(sets)), "id long, items array<bigint>")
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(tuple(s), i)
    rep = sorted(least.values())
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})
    monkeypatch.setattr(dedup, "MET", 3)
    for t in (0.5, 0.75, 0.9):
        want = {(a, b) for a in rep for b in rep if a < b and alike(a, b) >= t}
        assert {(x.a, x.b) for x in dedup.class_pairs(signs, t)[0].collect()} == want
    assert len(dedup.late_items(signs, 0.5)) > 5
    # two items that all share, first in the order, are no reason to weigh a pair: fifteen of the prefix have to be shared
    long = spark.createDataFrame([(i, [0, 1, *range(1000 * i, 1000 * i + 298)]) for i in range(1, 9)], "id long, items array<bigint>")
    first = dedup.prefixes(long, 0.9, spark.sparkContext.broadcast(np.zeros(0, np.int64)))
    assert first.count() == 8 * (300 - 270 + 1) and first.groupBy("item").count().where("count > 1").count() == 2
    assert dedup.candidates(first, first, 0.9).where("a < b").count() == 0


def test_search_deals_out_postings_of_its_terms_only(spark):
    docs = spark.range(1500).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.col("id") % 700 + i))).alias("text"))
    index = lexical.build(docs, "id").saved()
    asked = spark.range(300).select(F.col("id").alias("qid"), F.concat(F.lit("w"), F.col("id") % 3, F.lit(" w"), F.col("id") % 3 + 1).alias("query"))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    had = {stages().apply(i).stageId() for i in range(stages().size())}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = lexical.search(index, asked, 2).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.qid, r.id, r["rank"]) for r in hits if r.qid < 2) == [(0, 0, 1), (0, 700, 2), (1, 0, 1), (1, 1, 2)]
    done = [stages().apply(i) for i in range(stages().size())]
    assert max(s.shuffleWriteRecords() for s in done if s.stageId() not in had) < index.postings.count() / 10
