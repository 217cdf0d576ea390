"""SentencePiece encoding, alignment of two tokenizers, hard negatives: against the library and brute force."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import align, negatives, pieces, tokens
from granary.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ODD = ["a", "e", "t", "h", "  ", " ", "\n", "é", "▁", "日", "ゼ", "😀", "0", "1", "=", "-", "_", "ing", "tion", "</s>", "<0x0A>", "\0", "﻿", "Ａ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_path())


# ---- SentencePiece


def test_ids_and_texts_are_the_library_s(library, model):
    @settings(max_examples=1500, deadline=None)
    @given(st.one_of(st.lists(st.sampled_from(ODD), max_size=40).map("".join), st.text(max_size=60)))
    def same(text):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text).tolist() == ids and model.decode(ids) == library.decode(ids)

    same()


def test_runs_of_spaces(library, model):
    # pieces of spaces have one score: the leftmost join comes first
    for n in range(1, 120):
        for after in ("", "a", "\n", "é", "😀"):
            text = " " * n + after
            assert model.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), rng.randrange(130, 259)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_small_tables_and_long_words(library, monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    own = pieces.Model(pieces.default_path())
    rng = random.Random(3)
    long = "".join(rng.choices("abcdeé☃", k=30_000))
    for text in (long, long[:300] + " of the things" * 20):
        assert own.encode(text).tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(own._pairs) <= 5 and len(own._seen) <= 3


def test_places_fail_and_are_taken_back(model):
    """Texts whose longest pieces from the left can't stand, so that the bitfield is used."""
    back = 0
    for a in list(model.ids)[300:3000]:
        for b in ("e", "ing", "s"):
            word = "▁" + (a + b).lstrip("▁")
            at, greedy = 0, []
            while at < len(word):
                n = next(n for n in range(min(len(word) - at, 20), 0, -1) if n == 1 or word[at : at + n] in model.ids)
                greedy.append(word[at : at + n])
                at += n
            merged = model.merge(word)
            assert [model.name[i] for i in model.part(word)] == merged
            back += merged != greedy
    assert back > 100


def test_codec_tables(spark, documents, library, prose):
    texts = [(1, None), (2, ""), (3, " a  b "), (3, " a  b "), (4, prose(1, 20_000)), (5, "x▁y"), (None, "é")]
    docs = documents(texts).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    rows = sorted(pieces.digests(docs).collect(), key=str)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: str(spark.createDataFrame([r], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").first()))
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t in texts}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    assert pieces.digests(documents([])).count() == pieces.encode(documents([])).count() == 0


# ---- alignment


def plain_report(rows):
    """The contract word by word."""
    a_side, b_side = Tokenizer.from_file(tokens.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    a_side.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    name = {i: t for t, i in json.load(open(tokens.default_path()))["model"]["vocab"].items()}
    docs, counts = [], Counter()
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in name[i]) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append((doc, [], 0, 0))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            left, right = np.searchsorted(ends_a, cut, "right"), np.searchsorted(ends_b, cut, "right")
            groups.append((a[x:left], b[y:right]))
            x, y = left, right
        docs.append((doc, groups, len(a), len(b)))
        counts.update({(p, q) for g, h in groups for p in g for q in h})
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for doc, groups, n_a, n_b in docs:
        links = [(p, q) for g, h in groups for p in g for q in h]
        spelled = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ALIGNED = [(-1, None), (-2, ""), (-3, "a▁b"), (-4, "<|endoftext|> </s> x"), (-5, " "), (-6, "  \n\n\t é日本😀‍" * 20), (-6, "a" * 9000), (-6, "a" * 9000), (None, "=-" * 1800), (-7, "\0ab")]


@pytest.mark.parametrize("block, many", [(1 << 21, 1 << 10), (1 << 10, 3)])
def test_report_against_brute_force(spark, monkeypatch, block, many):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "MANY", many)
    monkeypatch.setattr(align, "SLICE", 1 << 15)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ALIGNED, "doc_id long, text string"))
    docs = docs.withColumn("block", F.lit("x")).withColumn("pairs", F.lit(1))
    got = align.report(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_report([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_and_overlaps_tile_the_text(spark, documents):
    readers = align.load(*align._paths(None, None))
    for r in align.aligned(documents([(i, t) for i, (_, t) in enumerate(ALIGNED)])).collect():
        text = ALIGNED[r.doc_id][1]
        if not r.a_ids:
            assert not (r.b_ids or r.groups or r.overlaps)
            continue
        sizes = readers.a_size[r.a_ids], readers.b_size[r.b_ids]
        n = len((" " + text).encode())
        owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
        assert sum(o.bytes for o in r.overlaps) == n and Counter({(o.a, o.b): o.bytes for o in r.overlaps}) == Counter(zip(*owner))
        starts = [0]
        for g in r.groups:
            assert g.byte == starts[-1] and g.n_a and g.n_b
            at_a, at_b = sum(x.n_a for x in r.groups[: len(starts) - 1]), sum(x.n_b for x in r.groups[: len(starts) - 1])
            ends = [np.cumsum(s[at : at + k]) for s, at, k in ((sizes[0], at_a, g.n_a), (sizes[1], at_b, g.n_b))]
            assert set(ends[0]) & set(ends[1]) == {ends[0][-1]}
            starts.append(g.byte + int(ends[0][-1]))
            if len(starts) > 200:
                break
        else:
            assert starts[-1] == n
    assert align.report(documents([])).count() == align.aligned(documents([])).count() == 0


# ---- hard negatives


def plain_negatives(rows, positives=5, negatives_=5, window=(80, 100)):
    own = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in own:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in own if i != a and len(w) == len(v)]
        for p, who, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            near = sorted(s for s in scored if s[2] != label and window[0] * -p <= 100 * -s[0] <= window[1] * -p)
            out += [(a, who, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(near[:negatives_])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("group, anchors, numbers", [(1 << 22, 512, 1 << 18), (60, 2, 64)])
def test_negatives_against_brute_force(spark, monkeypatch, group, anchors, numbers):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 8)).astype(np.float32)
    vectors = [base[rng.integers(6)] + np.float32(0.25) * rng.integers(-1, 2, 8).astype(np.float32) for _ in range(700)]
    rows = [(i, int(rng.integers(4)), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, i % 4, rows[100][2]) for i in range(400)]  # copies of an anchor, anchors among them
    rows += [(2000, None, rows[1][2]), (2100, 1, None), (2200, 1, [1.0, None] + [0.0] * 6), (2300, 1, [float("nan")] * 8), (2400, 2, [float("inf")] * 8), (2500, 1, []), (2600, 1, [0.5, 0.25]), (2601, 2, [0.5, 0.25]), (2602, 1, [0.5, 0.25]), (None, 1, rows[1][2])]
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "NUMBERS", numbers)
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>").withColumn("row", F.lit("x")).withColumn("group", F.lit("y")).repartition(3)
    if group < 100:
        frame = frame.where("vec_id < 300 OR vec_id >= 1150")
        rows = [r for r in rows if r[0] is not None and (r[0] < 300 or r[0] >= 1150)]
    got = sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 100 == 0).select(COLUMNS).collect())
    want = plain_negatives(rows)
    assert got == want and len({r[0] for r in want}) > 3


def test_scores_beyond_float64_are_exact(spark):
    big = float(2**22)
    rows = [(0, 1, [big] * 3), (1, 1, [big, big, big - 0.5]), (2, 2, [big, big, big - 1]), (3, 2, [big, big - 0.25, big - 0.5]), (4, 1, [-big, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")
    got = sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 100 == 0).select(COLUMNS).collect())
    assert got == plain_negatives(rows) and got[0][4] > 2**60
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(spark.createDataFrame([(0, 1, [3e38]), (1, 1, [3e38])], "vec_id long, label int, vector array<float>"), F.col("vec_id") % 100 == 0).collect()


def test_no_anchor_no_row(spark):
    rows = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, vector array<float>")
    assert negatives.mine(rows, F.col("vec_id") % 100 == 0).count() == negatives.mine(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert set(QUERIES) >= {"op11_cross_tokenizer_alignment", "op12_sentencepiece", "op13_hard_negatives"} and "op13_hard_negatives" in SQL
