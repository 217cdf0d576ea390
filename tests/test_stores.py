"""Written indexes and tables: results of brute force, changes, reruns, and what a search reads."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import changes, dedup, incremental, ivf, keyed, lexical, postings, topk, vectors

WORDS = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def texts(n, seed=0, size=40):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randint(0, size)))) for i in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    plain = [(i, " ".join(rng.choices(WORDS, k=1 + i % 3))) for i in range(12)]
    return spark.createDataFrame([*plain, (90, "ak_bl"), (91, "jt_js it"), (92, "?!"), (93, "nowhere"), (94, "jt jt")], "qid int, query string")


def ranked(df):
    return sorted((r.qid, r.rank, r.id, round(r.bm25, 8)) for r in df.collect())


# ---- postings


def test_blocks_give_what_the_plain_index_gives(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(postings, "SEEDS", 1)
    docs = spark.createDataFrame(texts(300), "doc_id long, text string")
    store = postings.Store.create(docs, str(tmp_path), stem=True, per_range=8)
    want = ranked(lexical.search(lexical.build(docs, stem=True), asked, 5))
    assert ranked(store.search(asked, 5)) == want and {q for q, *_ in want} >= {0, 1, 94}
    monkeypatch.setattr(postings, "FEW_TERMS", 0)  # terms joined, not named
    assert store.few_terms(asked) is None and ranked(store.search(asked, 5)) == want


def test_segments_give_what_an_index_built_anew_gives(spark, tmp_path, asked):
    old = dict(texts(200))
    now = {i: t for i, t in old.items() if i % 9} | {i: "ak bl " + old[i] for i in range(0, 200, 4)} | {i + 1000: t for i, t in texts(40, 5)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    hashed = lambda d: frame(d).select("doc_id", changes.content_hash(F.col("text")).alias("content_hash"))
    found = changes.diff(hashed(old), hashed(now))
    states = {r.doc_id: r.state for r in found.collect()}
    assert states == {i: "gone" if i not in now else "new" if i not in old else "same" if old[i] == now[i] else "changed" for i in old | now}
    store = postings.Store.create(frame(old), str(tmp_path), per_range=16)
    store.apply(*changes.split(found, frame(now)))
    want = ranked(lexical.search(lexical.build(frame(now)), asked, 6))
    assert ranked(store.search(asked, 6)) == want
    assert store.stats().first() == lexical.build(frame(now)).stats().first()
    # a segment that broke off before it counted changes nothing, and is written over
    for name in ("blocks", "lengths", "gone"):
        spark.read.parquet(f"{tmp_path}/{name}/segment=1").write.parquet(f"{tmp_path}/{name}/segment=2")
    assert ranked(store.search(asked, 6)) == want
    later = {i: t for i, t in now.items() if i != 1003}
    assert store.apply(frame({5: "jt"}), frame({1003: ""}).select("doc_id")) == 2
    assert ranked(store.search(asked, 6)) == ranked(lexical.search(lexical.build(frame(later | {5: "jt"})), asked, 6))


def test_a_search_reads_the_row_groups_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i:05d} common") for i in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one file
    store = postings.Store.create(docs, str(tmp_path), per_range=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = store.blocks(["w00007", "w03999"])
    assert rows.count() == 2
    rows = store.blocks(["w00007"]).select("term", "n")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w00007)" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "ids" not in plan.split("ReadSchema")[1]
    rows.collect()
    scans = [x for x in _leaves(rows._jdf.queryExecution().executedPlan()) if x.metrics().contains("numOutputRows")]
    read = sum(x.metrics().apply("numOutputRows").value() for x in scans)
    assert 0 < read < 3000 and spark.read.parquet(f"{tmp_path}/blocks").count() > 4000


def _leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_empty_index(spark, tmp_path, asked):
    store = postings.Store.create(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path))
    assert store.search(asked, 3).count() == 0
    store.apply(spark.createDataFrame([(1, None), (2, "ak bl")], "doc_id long, text string"))
    assert [r.id for r in store.search(spark.createDataFrame([(1, "ak_bl")], "qid int, query string"), 3).collect()] == [2]


# ---- vectors


def cloud(n, dim=16, seed=1, centers=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((centers, dim))[rng.integers(centers, size=n)] + 0.4 * rng.standard_normal((n, dim))
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 4).astype(np.float32)


def brute(x, ids, q, k):
    s = np.round(q.astype(np.float64) @ x.T.astype(np.float64), 9)
    return [[ids[i] for i in np.lexsort((ids, -row))[:k]] for row in s]


def table(spark, x, ids, kind="long"):
    return spark.createDataFrame([(i if kind == "long" else f"id{i:05d}", v.tolist()) for i, v in zip(ids, x)], f"vec_id {kind}, embedding array<float>").repartition(5)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_neighbours_of_many_ties(spark, monkeypatch):
    x, ids = np.concatenate([cloud(200), np.repeat(cloud(1, seed=2), 500, axis=0)]), list(range(700))
    q = np.concatenate([cloud(9, seed=3), x[-1:]])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, embedding array<float>")
    want = dict(enumerate(brute(x, ids, q, 7)))
    assert found(vectors.knn(table(spark, x, ids), asked, 7)) == want
    # other groups and blocks, and ids that are strings
    monkeypatch.setattr(topk, "GROUP", 40)
    monkeypatch.setattr(vectors, "NUMBERS", 16 * 30)
    got = found(vectors.knn(table(spark, x, ids, "string"), asked, 7))
    assert got == {i: [f"id{j:05d}" for j in row] for i, row in want.items()}


def test_an_id_with_many_near_vectors_takes_one_place(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0])] * 400 + [(c, [0.5 + i / 100, 0.1]) for i, c in enumerate("bcdefghi")], "vec_id string, embedding array<float>").repartition(6)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<float>")
    assert found(vectors.knn(rows, asked, 4)) == {1: ["a", "i", "h", "g"]}


def test_lists_probed_and_exact(spark, tmp_path, monkeypatch):
    x, ids = cloud(3000), list(range(3000))
    rows = table(spark, x, ids).unionByName(spark.createDataFrame([(9999, None)], "vec_id long, embedding array<float>"))
    index = ivf.Lists.build(rows, str(tmp_path))
    assert sorted(r.id for r in index.assignment().collect()) == ids  # every row once
    q = np.round(x[::75] + 0.05 * cloud(40, seed=8), 4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, embedding array<float>")
    want = dict(enumerate(brute(x, ids, q, 10)))
    probes, recall = index.tune(rows, 10)
    got = found(index.search(asked, 10, probes))
    share = np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.95 and share >= 0.9 and probes < len(index.centers)
    assert found(index.search(asked, 10, 1, exact=True)) == want
    monkeypatch.setattr(ivf, "FEW_LISTS", 0)
    assert found(index.search(asked, 10, 3, exact=True)) == want


def test_lists_of_few_rows(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<float>")
    assert ivf.Lists.build(none, str(tmp_path / "a")).search(asked, 3, 2, exact=True).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert found(ivf.Lists.build(same, str(tmp_path / "b")).search(asked, 3, 1, exact=True)) == {1: [0, 1, 2]}
    with pytest.raises(ValueError):
        ivf.Lists.build(same.unionByName(spark.createDataFrame([(77, [1.0])], same.schema)), str(tmp_path / "c"))


# ---- batches


def near(n, seed):
    """Texts among which copies with small edits of earlier ones stand."""
    rng, out = random.Random(seed), []
    for i in range(n):
        base = out[rng.randrange(len(out))][1].split() if out and rng.random() < 0.6 else rng.choices(WORDS, k=rng.choice([0, 3, 60, 90]))
        for _ in range(rng.randint(0, 2) if len(base) > 50 else 0):
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        out.append((i, " ".join(base)))
    return out


def test_batches_keep_what_one_run_keeps(spark, tmp_path):
    rows = near(240, 4)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    want = {r.id: r.kept for r in dedup.deduplicate(frame(rows), 0.8).collect()}
    corpus = incremental.Corpus(spark, str(tmp_path), 0.8)
    for i, cut in enumerate([rows[:60], rows[60:]]):
        corpus.add(frame(cut), i)
    assert {r.id: r.kept for r in corpus.verdicts().collect()} == want and 20 < sum(want.values()) < 220
    # the last batch again: the same verdicts, and no row twice
    corpus.add(frame(rows[60:]), 1)
    assert {r.id: r.kept for r in corpus.verdicts().collect()} == want and corpus.verdicts().count() == 240
    # all of it once more: nothing new is kept, whatever the ids
    assert not any(r.kept for r in corpus.add(frame([(i + 1000, t) for i, t in rows])).collect())
    with pytest.raises(ValueError):
        corpus.add(frame(rows), 0)


# ---- keyed tables


def files(base):
    return {os.path.relpath(f, base) for f in glob.glob(f"{base}/rows/**/*.parquet", recursive=True)}


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    frame = lambda r: spark.createDataFrame(r, "k long, bucket string, v int")
    table = keyed.KeyedTable.create(frame([(i, "x", i) for i in range(200)]), str(tmp_path), "k", buckets=16)
    before = files(tmp_path)
    touched = table.upsert(frame([(3, "y", -3), (500, "y", -5)]), frame([(4, "", 0)]).select("k"))
    after = files(tmp_path)
    own = lambda names, b: {f for f in names if f"={b}/" in f}
    assert 1 <= len(touched) <= 3 and all(own(before, b) == own(after, b) for b in range(16) if b not in touched) and all(own(before, b) != own(after, b) for b in touched)
    want = {i: ("x", i) for i in range(200) if i not in (3, 4)} | {3: ("y", -3), 500: ("y", -5)}
    assert {r.k: (r.bucket, r.v) for r in table.rows().collect()} == want
    assert [tuple(r) for r in table.lookup(frame([(3, "", 0), (4, "", 0), (9999, "", 0)])).collect()] == [(3, "y", -3)]


def test_an_upsert_that_broke_off_is_finished(spark, tmp_path):
    frame = lambda r: spark.createDataFrame(r, "k long, v int")
    table = keyed.KeyedTable.create(frame([(i, i) for i in range(50)]), str(tmp_path), "k", buckets=8)
    touched = table._merge(frame([(1, -1), (77, -7)]), None)
    table._delete(spark, f"{tmp_path}/rows/bucket={touched[0]}")  # as if folders were being replaced
    again = keyed.KeyedTable(spark, str(tmp_path))
    want = {i: i for i in range(50)} | {1: -1, 77: -7}
    assert {r.k: r.v for r in again.rows().collect()} == want
    # one that wasn't written whole is forgotten
    table._merge(frame([(2, -2)]), None)
    table._delete(spark, f"{tmp_path}/pending/touched")
    assert {r.k: r.v for r in keyed.KeyedTable(spark, str(tmp_path)).rows().collect()} == want
    # every row of a bucket gone
    table.upsert(frame([]), frame([(i, 0) for i in [*range(50), 77]]).select("k"))
    assert table.rows().count() == 0 and not files(tmp_path)
    table.upsert(frame([(1, 1)]))
    assert [tuple(r) for r in table.rows().collect()] == [(1, 1)]


def test_terms_of_a_document_are_grouped_in_its_task(spark, monkeypatch):
    """No word is dealt out for the index; rows of one id are one document, whatever slices they are in."""
    from granary.operators import lexical

    monkeypatch.setattr(lexical, "SLICE", 5)
    rows = [(1, "b a b c a b"), (2, None), (3, ""), (4, "running runs a"), (None, "a b"), (5, "x " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = lexical.build(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = [(w, i, len(at), at) for i, t in rows for w in set((t or "").split()) for at in [[n for n, x in enumerate(t.split()) if x == w]]]
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    got = lambda x: sorted(((r.term, r.id, r.tf, list(r.places)) for r in x.postings.collect()), key=key)
    assert got(index) == sorted(want, key=key)
    assert [r[1:] for r in got(lexical.build(docs, stem=True)) if r[0] == "run"] == [(4, 2, [0, 1])]
    twice = lexical.build(docs.unionByName(spark.createDataFrame([(1, "a z")], docs.schema)))
    assert [r[2:] for r in got(twice) if r[:2] == ("a", 1)] == [(3, [0, 1, 4])]
