import hashlib
import json
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import prompts, similarity
from granary.functions import text as T
from granary.functions.porter import fold, stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "given_, expected",
    [
        ("a  b\t\tc \n\n\n\nd", "a b c\n\nd"),
        ("```\nx  y &amp; z\n```", "```\nx  y & z\n```"),
        ("ﬁne\x0c &lt;b&gt;", "fine <b>"),
        ("[[[CODE_7]]] stays", "[[[CODE_7]]] stays"),
        ("a  \n~~~\n 1  2 \n\n\n\n~~~  \n\n\n\nb \t", "a\n~~~\n 1  2 \n\n\n\n~~~\n\nb"),
        ("one  two é &amp;", "one two é &"),
        ("", ""),
    ],
)
def test_normalize(spark, given_, expected):
    assert T.normalize_string(given_) == expected
    assert one(spark, given_, T.normalize_text) == expected


def test_native_normalisation_is_the_same_on_plain_text(spark):
    rows = ["a  b \n\n\n\n c\t", " x\x01y ", "\n\nq \n", "é  à\n \nz"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select(T.normalize_text(F.col("v"), native=True).alias("n"), T.is_plain(F.col("v")).alias("p")).collect()
    assert [g.n for g in got] == [T.normalize_string(r) for r in rows] and all(g.p for g in got)
    assert not one(spark, "a &amp; b", T.is_plain, "string")


def test_fingerprints(spark):
    for raw, out in [("the Italian", "italian"), ("Persian", "farsi"), ("native language", "farsi"), ("Fārsi", "farsi"), ("Italiano!", "italian!")]:
        assert one(spark, raw, T.fingerprint_form) == out


def test_numbers(spark):
    assert ",".join(one(spark, "1,234.50 vs 12% of 1234,567 and v1.2.3 5%", T.numbers)) == "1234.50,12,1234,567,1.2,3,5"
    df = spark.createDataFrame([("5% of 3", "3 of 5"), ("1 2", "1 1 2")], "a string, b string")
    assert [r[0] for r in df.select(T.numbers_preserved(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_match_expression(spark):
    assert one(spark, "fārsi C++ foo-bar", T.match_expression) == '"f" AND "rsi" AND "C" AND "foo" AND "bar"'
    assert one(spark, "?!", T.match_expression) == '""'


def test_shingles(spark):
    f = lambda k: lambda c: T.shingles(F.split(c, " "), k)
    assert one(spark, "a b c d", f(5)) == []
    assert one(spark, "a b a", f(1)) == ["a", "b"]
    assert one(spark, "a b a b a", f(2)) == ["a b", "b a"]


def test_words_as_in_python(spark):
    rows = ["it's a well-known -dash- 'quote' x_y", "naïve café 12-3", "--", "a'"]
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(T.words(F.col("v")))
    assert [r[0] for r in df.collect()] == [re.findall(r"\b[\w'-]+\b", r) for r in rows]


def test_cache_key(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = h(json.dumps({"v": "v1", "t": h("text"), "s": h("style"), "m": 256}))
    assert one(spark, "text", lambda c: T.cache_key(c, F.lit("style"), 256)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert similarity.lcs_length(a, b) == row[-1]


def test_rouge_and_safety(spark):
    df = spark.createDataFrame([("a b c d", "a b d", 0.75), ("", "x", 0.0), ("p q", "q p", 0.5)], "a string, b string, want double")
    rows = df.select(similarity.rouge_l(F.col("a"), F.col("b")).alias("r"), "want", similarity.passes_safety(F.col("a"), F.col("b")).alias("ok")).collect()
    assert all(r.r == r.want for r in rows) and [r.ok for r in rows] == [True, False, False]


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (2, 3, 4)], "i int, a int, b int")
    assert [r[0] for r in df.select(similarity.jaccard(F.col("i"), F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.4]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("running", "run"), ("is", "is")])
def test_stems(word, want):
    assert stem(word) == want


def test_fold():
    assert fold("RUNNING") == "run" and fold("café") == "cafe"


def test_prompts(spark):
    turns = [("user", "hi "), ("assistant", "yes"), ("user", "more")]
    df = spark.createDataFrame([(turns,)], "h array<struct<role:string,content:string>>")
    got = df.select(prompts.flattened(F.col("h")).alias("f"), prompts.echo(F.col("h")).alias("e"), prompts.echo(F.slice("h", 2, 1)).alias("n")).first()
    assert got.f == "USER:\nhi\n\nASSISTANT:\nyes\n\nUSER:\nmore\n"
    assert got.e == "[ECHO RESPONSE]\nmore" and got.n == "[ECHO RESPONSE]\n(no user input)"


def test_counter_is_multiset():
    assert Counter("aab") != Counter("ab")
