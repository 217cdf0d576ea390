"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the K most frequent letter n-grams (N_MIN to N_MAX letters, words
padded by a blank) by rank. A text goes to the language whose profile its own
ranks are least out of place with: the sum of rank differences, K for an n-gram
that the profile lacks. The score is 1 minus that distance over the greatest
possible one.

Profiles count every training row. Partial counts leave each task in bounded
portions and are summed before ranking. Languages are limited to MAX_LANGS,
checked, so profiles are small enough to send to every task.

Edges: a null text, or one without a letter, is `und` with score 0; rows with null
language teach nothing; where nothing is learned all texts are `und`. Equal
distances go to the first language in order. Repeated rows count as often as they
occur in training and get equal predictions. Long texts are counted in blocks, cut
between words; a word of half a block or more is cut inside. Empty tables give empty
ones. Other columns, whatever their names, are ignored unless `keep` has them; none of
them is an input of a prediction.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import words

K = 500
N_MAX = 4
MAX_LANGS = 1000
BLOCK = 1 << 20
FLUSH = 2_000_000
_BLANK = np.uint64(32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (keys, counts)."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _grams(text: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and their counts of each of some lower-cased texts."""
    cp = np.frombuffer((" " + " ".join(text) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) + 1 for x in text])
    owner = np.concatenate([[0], np.repeat(np.arange(len(text)), size)])
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code = (cp ^ (cp >> 16) * np.uint32(0x9E37)) & np.uint32(0xFFFF)  # beyond the first plane: folded
    code = np.where(code <= 32, code + np.uint32(256), code)  # a folded letter is never the blank
    c, owner = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep]
    blank = c == _BLANK
    made = []
    for n in range(1, N_MAX + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        key = np.zeros(m, np.uint64)
        for j in range(n):
            key = (key << np.uint64(16)) | c[j : j + m]
        if n == 1:
            ok, at = ~blank, owner
        elif n == 2:
            at = np.where(blank[:m], owner[1:], owner[:m])
            ok = ~(blank[:m] & blank[1:])
        else:
            ok, at = ~blank[1 : m + 1], owner[1 : m + 1]
            for j in range(2, n - 1):
                ok = ok & ~blank[j : j + m]
        key, at = key[ok], at[ok]
        made.append((key, np.searchsorted(at, np.arange(len(text) + 1))))
    return [_unique(np.concatenate([k[cut[i] : cut[i + 1]] for k, cut in made])) if made else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i in range(len(text))]


def grams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")).to_pylist()
    if sum(map(len, text)) <= 2 * BLOCK or len(text) > 1:
        return _grams(text)
    parts = []
    at = 0
    while at < len(text[0]):  # one long text: cut at a non-letter, or inside a word of a block's length
        end = min(len(text[0]), at + BLOCK)
        while end < len(text[0]) and end > at + BLOCK // 2 and text[0][end].isalpha():
            end -= 1
        parts += _grams([text[0][at:end]])
        at = end
    return [_merge([p[0] for p in parts], [p[1] for p in parts])]


def _ranked(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent keys, first the most frequent, equal ones by key."""
    if counts.max() < 65536:
        return keys[np.argsort(np.uint16(65535) - counts.astype(np.uint16), kind="stable")[:k]]
    return keys[np.argsort(-counts, kind="stable")[:k]]


def profiles(train: DataFrame, text: str = "text", lang: str = "lang", k: int = K) -> list[tuple[str, np.ndarray]]:
    """The ranked n-grams of each language of `train`, by name."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(lambda: [[], []])
        size = 0

        def out(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for name, (a, b) in list(held.items()):
                key, n = _merge(a, b)
                if len(key) >= least:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
                    del held[name]
                else:
                    held[name] = [[key], [n]]
                    size += len(key)

        for batch in batches:
            for part in words.slices(batch, 1):
                for name, (key, n) in zip(part.column(0).to_pylist(), grams(part.column(1))):
                    held[name][0].append(key)
                    held[name][1].append(n)
                    size += len(key)
                if size > FLUSH:
                    yield from out(FLUSH // 4)
                    if size > FLUSH // 2:
                        yield from out(0)
        yield from out(0)

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the bound is checked, never cut to: more names than languages are a fault of the labels
    got = best.select("lang", "rank", "gram").limit(MAX_LANGS * k + 1).toArrow()
    if got.num_rows > MAX_LANGS * k:
        raise ValueError(f"more than {MAX_LANGS} languages: clean the labels first")
    by: dict[str, list] = defaultdict(list)
    for name, rank, gram in zip(*(got.column(i).to_pylist() for i in range(3))):
        by[name].append((rank, gram))
    return [(name, np.array([g for _, g in sorted(by[name])], np.int64).view(np.uint64)) for name in sorted(by)]


def classifier(learned: list[tuple[str, np.ndarray]], k: int = K):
    """A function from distinct n-grams and counts to (language, score)."""
    names = [name for name, _ in learned]
    vocab = np.unique(np.concatenate([g for _, g in learned])) if learned else np.zeros(0, np.uint64)
    ranks = np.full((len(vocab), len(names)), -1, np.int64)
    for i, (_, g) in enumerate(learned):
        ranks[np.searchsorted(vocab, g), i] = np.arange(len(g))

    def of(keys: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(keys) or not len(vocab):
            return "und", 0.0
        top = _ranked(keys, counts, k)
        at = np.minimum(np.searchsorted(vocab, top), len(vocab) - 1)
        known = vocab[at] == top
        theirs = ranks[at[known]]
        away = np.where(theirs < 0, k, np.abs(theirs - np.flatnonzero(known)[:, None])).sum(axis=0) + k * int((~known).sum())
        best = int(away.argmin())
        return names[best], 1.0 - float(away[best]) / (k * len(top))

    return of


def identify(docs: DataFrame, learned: list[tuple[str, np.ndarray]], keep: list[Column], text: str = "text", k: int = K) -> DataFrame:
    """The columns `keep` of docs, with lang_pred and score of its text."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    column = len(rows.columns) - 1
    # sent once to each worker, not with each task: names and ranks of at most MAX_LANGS * K n-grams
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classifier(sent.value, k)
        for batch in batches:
            for part in words.slices(batch, column):
                got = [of(*x) for x in grams(part.column(column))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
