"""Very long texts, ties, repeated rows and columns of clashing names, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontam, langid, licenses, lmscore, neardup, quality, tokencount, tokens

LONG = 300_000


@pytest.fixture(scope="module")
def far(prose):
    """A long text with a passage at each end."""
    return " ".join([prose(1, 30), prose(2, LONG), prose(3, 30)])


def test_leaks_far_apart_in_a_long_text(spark, documents, prose, far, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 30)) for i in (1, 3, 4)] + [(9, prose(1, 30))], "item_id long, text string")
    docs = documents([(1, far), (1, far), (2, prose(4, 30)), (None, None)]).withColumn("similarity", F.lit("x")).withColumn("item_id", F.lit(0))
    found = lambda: sorted((r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontam.find(docs, bench).collect())
    want = sorted([(1, i, at, 30) for i, at in ((1, 0), (3, 30 + LONG), (9, 0)) for _ in range(2)] + [(2, 4, 0, 30)])
    assert found() == want
    # stretches and portions of any size give the same windows
    monkeypatch.setattr(decontam, "STRETCH", 7)
    monkeypatch.setattr(decontam, "PAIRS", 5)
    assert found() == want
    assert [r.doc_id for r in decontam.keep_clean(docs, bench).collect()] == [None]


def test_no_fingerprint_within_the_radius_is_missed():
    rng = np.random.default_rng(5)
    index = decontam.Index([" ".join(f"a{rng.integers(10**6)}" for _ in range(25)) for _ in range(60)])
    item = rng.integers(60, size=4000)
    flips = np.zeros((4000, 64), bool)
    for row in flips:
        row[rng.permutation(64)[: rng.integers(0, 40)]] = True
    prints = index.prints[item] ^ np.packbits(flips, axis=1, bitorder="little")
    got = set(index.candidates(prints, 25))
    near = {(w, i) for w in range(4000) for i in range(60) if int(np.unpackbits(prints[w] ^ index.prints[i]).sum()) <= decontam.RADIUS}
    assert got == near and len(near) > 1000


def test_tokens_of_a_long_text(documents, far):
    encoder, _ = tokens.load(tokens.default_path())
    rows = tokencount.token_counts(documents([(1, far + "\nend")])).collect()
    assert len(rows) == 2 and sum(r.n_tokens for r in rows) == len(tokens.encode(encoder, far + "\nend"))


def test_losses_of_a_long_text(spark, documents, far):
    docs = documents([(1, far), (2, far), (2, far), (3, "a a")]).withColumn("score", F.lit("x")).withColumn("target", F.lit("y")).withColumn("_id", F.lit(1))
    got = lmscore.score(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()
    twice = [r for r in got if r.doc_id == 2]
    assert len(got) == 4 and twice[0] == twice[1] and twice[0].n_tokens == LONG + 60 and all(np.isfinite(r.score) for r in got)


def test_counts_of_a_long_text(documents, far):
    docs = documents([(1, far), (2, far), (3, "x " * 60)]).withColumn("own", F.lit(1)).withColumn("measure", F.lit(2))
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert got[1].n_words == LONG + 60 and got[1].kept and got[2].kept and got[3].base_failed


def test_near_copies_of_a_long_text(documents, far):
    docs = documents([(5, far), (3, far + " more"), (7, "other words than those of that text")]).withColumn("ckey", F.lit("x")).withColumn("component_id", F.lit(1))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {5: 3, 3: 3, 7: 7}
    assert {r.doc_id for r in neardup.keep_first(docs).collect()} == {3, 7}


def test_equal_distances_go_to_the_first_language(spark, documents):
    learned = langid.profiles(spark.createDataFrame([("ab", "b"), ("ab", "a"), ("cd", "c")], "text string, lang string"))
    docs = documents([(1, "ab"), (1, "ab"), (2, "zz")]).withColumn("lang_pred", F.lit("c"))
    assert [(r.doc_id, r.lang_pred) for r in langid.identify(docs, learned, [F.col("doc_id")]).orderBy("doc_id").collect()] == [(1, "a"), (1, "a"), (2, "a")]


def test_licences_of_ties_and_clashing_names(spark):
    both = "Released under the MIT License.\nReleased under the ISC License.\n"
    rows = [("a/LICENSE", both), ("a/COPYING", both), ("a/x", None), ("a/x", None), ("b/x", "")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("file", F.lit(1)).withColumn("own", F.lit(2)).withColumn("dir", F.lit(3)).withColumn("score", F.lit(4)).withColumn("up", F.lit(5))
    got = sorted((r.path, r.license, r.licence_path) for r in licenses.scan(files).collect())
    assert got == [("a/COPYING", "MIT", None), ("a/LICENSE", "MIT", None), ("a/x", "MIT", "a/COPYING"), ("a/x", "MIT", "a/COPYING"), ("b/x", "none", None)]
    kept = licenses.scan(files, keep=["own", "score"]).columns
    assert kept[:2] == ["own", "score"]


def test_random_texts_of_any_bytes(documents):
    rng = random.Random(4)
    docs = documents([(i, "".join(chr(rng.choice([0, 9, 10, 32, 65, 233, 0x4E2D, 0x1F600])) for _ in range(rng.randint(0, 200)))) for i in range(40)])
    assert quality.quality(docs).count() == tokencount.token_counts(docs).select("doc_id").distinct().count() == neardup.near_duplicates(docs).count() == 40
