"""The pipeline and each of its stages: odd rows and columns of any name, and the whole against brute force."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import sieve, tokens
from granary.llm.oracles import SQL

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, in one place or another.
NAMES = "own_n own_low all_low wide_n gone_id gone sieve_row sieve_key sieve_at sieve_words sieve_own lines_gone lines_id lines_tf fence_lang fence_low quality_counts quality_kept near_row near_own near_of counts kept component_id node root key line tf first size keys norm raw piece start length salt rank id hash at words_ order_ item_id n_words".split()


@pytest.fixture(scope="module")
def odd(spark, prose):
    texts = [prose(i, 90) for i in range(12)]
    texts += [texts[0], texts[0], texts[1] + " x", "\n".join([prose(50, 60), "", " -- ", prose(50, 60)]), " ".join(texts[i] for i in range(12)) + " " + prose(77, 700_000), "é" * 3000, "", None, "one", " \t\n", "\n\n\n"]
    rows = [(i if i != 5 else None, t, None if i == 3 else "en", None if i in (3, 4) else "s", None if t is None else len(t), *[f"{c}/{i}" for c in NAMES]) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (2, "another text of one id " + prose(8, 70), "en", "s", 1, *[f"{c}/again" for c in NAMES])]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in NAMES]]))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_columns_of_any_name(spark, odd, name, stage):
    before, after = odd.collect(), stage(spark, odd, SF)
    assert after.columns == odd.columns and after.dtypes == odd.dtypes
    known = Counter(tuple(r[5:]) for r in before)
    found = Counter(tuple(r[5:]) for r in after.collect())
    assert not found - known, "a row was made or changed"
    if name == "line dedup":
        assert found == known
    if name == "near dedup":
        # of rows that repeat id and text one stays; another text of that id is a document of its own
        assert found[tuple(f"{c}/2" for c in NAMES)] == 1 and found[tuple(f"{c}/again" for c in NAMES)] == 1
        assert found[tuple(f"{c}/5" for c in NAMES)] == 1  # the null id
    if name == "quality rules":
        assert all(re.search("[a-z]", r.text or "") for r in after.select("text").collect())
    assert stage(spark, odd.limit(0), SF).columns == odd.columns and stage(spark, odd.limit(0), SF).count() == 0


def test_packing_of_odd_rows(spark, odd):
    rows = corpus_pipeline.sequences(spark, odd, SF).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert all(r.offset + r.length <= 2048 for r in rows)


def test_sieve_never_loses_a_key(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), F.lit(1).alias("sieve_at"), F.lit(2).alias("row")).unionByName(spark.createDataFrame([(None, 1, 2)], "k long, sieve_at int, row int"))
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("words"))
    yes, no = (sieve.maybe(rows, F.col("k"), keys, F.col("words"), w) for w in (True, False))
    assert yes.columns == rows.columns and yes.count() + no.count() == rows.count()
    assert no.join(keys, F.col("k") == F.col("words")).count() == 0
    assert yes.count() < 5000 / 7 + 100
    assert sieve.maybe(rows, F.col("k"), keys.limit(0), F.col("words"), True).count() == 0


def _closure(edges):
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return root


def _distances(pairs):
    con = duckdb.connect()
    con.execute("create table p (i int, a varchar, b varchar)")
    con.executemany("insert into p values (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    return [x for _, x in sorted(con.execute("select i, levenshtein(a, b) from p").fetchall())]


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_pipeline_against_brute_force(spark, prose, tmp_path):
    rng = random.Random(3)

    def edited(text, n):
        w = text.split(" ")
        for k in rng.sample(range(len(w)), n):
            w[k] = f"new{rng.randrange(10**6)}"
        return " ".join(w)

    bench = [(i, prose(9000 + i, 30)) for i in range(3)]
    texts = {i: "\n".join(prose(100 * i + j, 25) for j in range(5)) for i in range(30)}
    texts |= {40: texts[1].replace("\n", " "), 41: texts[2] + "\n" + edited(prose(201, 25), 1), 42: "\n".join([texts[3].split("\n")[0], prose(7, 80)]), 43: prose(8, 60) + " " + bench[1][1] + " " + prose(9, 60), 44: "Other, " + bench[2][1].split(" ", 1)[1] + "\n" + prose(10, 70)}
    texts |= {50: prose(11, 20), 51: " ".join(f"{w}###" for w in prose(12, 90).split()), 52: "again and again " * 40, 53: edited(texts[5].replace("\n", " "), 3), 54: texts[6]}
    rows = [(i, t, "en", "s", len(t)) for i, t in sorted(texts.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    docs = dict(con.execute(f"select doc_id, d.text from ({SQL['op5_quality_rules']}) q join documents d using (doc_id) where kept").fetchall())
    assert len(docs) == len(texts) - 3

    norm = lambda line: " ".join(re.findall("[a-z0-9]+", line.lower()))
    at = [((i, j), norm(x)) for i, t in sorted(docs.items()) for j, x in enumerate(t.split("\n")) if norm(x)]
    distinct = sorted({t for _, t in at})
    pairs = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b))]
    root = _closure([(a, b) for (a, b), d in zip(pairs, _distances(pairs)) if d <= 0.2 * max(len(a), len(b))] + [(t, t) for t in distinct])
    first: dict = {}
    for place, t in at:
        first.setdefault(root(t), place)
    gone = {place for place, t in at if first[root(t)] != place}
    docs = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in docs.items()}

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := _words(t)) >= 5 else {tuple(w)} if w else set() for i, t in docs.items()}
    ids = sorted(docs)
    root = _closure([(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] + [(i, i) for i in ids])
    docs = {i: t for i, t in docs.items() if root(i) == i}

    def leaks(text):
        w = re.findall("[a-z0-9]+", text.lower())
        bag = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4))
        for _, item in bench:
            want = bag(item.split())
            for s in range(max(1, len(w) - 29)):
                got = bag(w[s : s + 30])
                if sum((got & want).values()) >= 0.8 * sum((got | want).values()) > 0:
                    return True
        return False

    docs = {i: t for i, t in docs.items() if not leaks(t)}
    assert {43, 44}.isdisjoint(docs) and 54 in docs  # 54 is empty after the line stage

    encoder, _ = tokens.load(tokens.default_path())
    sizes = {i: len(tokens.encode(encoder, t)) + 1 for i, t in docs.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted((i, 0, 0, n) for i, n in sizes.items())
    gaps: list = []
    for n in sorted(sizes.values(), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 2048) - n)
    assert len({r.sequence_id for r in rows}) == len(gaps)
