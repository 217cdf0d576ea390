"""Cross-entropy difference of documents under a target and a background bigram model.

Both models have one vocabulary (the most frequent words of all documents, the rest
as one unknown word), one order, one smoothing and one table of hashed bigrams, so
they differ in nothing but what they counted: the target model the rows whose id is a
target, the background model all others. Every row is counted in one of them, and
counts of all words and bigrams are gathered from every task. The vocabulary and the
table grow with the tokens of the corpus, a word in WORD_SHARE tokens and a bucket in
BUCKET_SHARE. The table grows without end, and no task holds it: blocks of documents
send the buckets that they have to the parts of the table, PART_BUCKETS each, where their counts
are added up, and each block gets the sums of its own buckets back. So the texts are read twice,
for the vocabulary and for the blocks, whatever the number of parts, and a part has as many
entries at any size. The vocabulary has at most MOST_WORDS, and all other words are one
(both are parameters of the call).

The background has many times the target's words. So that the two are comparable its
counts are divided by the ratio of their tokens before they are smoothed: both models
then have as many tokens in all, and the smoothing weighs alike.

A word's loss is -log of (bigram + MASS * unigram) / (context + MASS), the unigram
smoothed by one. A document's own counts are taken out of the model that counted
it before it is scored, so a target document gains nothing from being one.

Edges: a null text, or one without words, has no tokens and null losses; rows with
null ids are background; repeated rows are counted as often as they occur, and share
their scores; words of equal frequency (ties) are in the vocabulary together or not
at all. Without targets the target model is uniform. A very long text is read in
slices of whole texts, so it is held once. An empty table gives an empty table;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words
from granary.llm.storage import Scratch

WORD_SHARE, LEAST_WORDS, MOST_WORDS = 16, 1 << 16, 1 << 19
BUCKET_SHARE, LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 20, 1 << 22
#: Buckets of a part of the table to which blocks of documents send their own; words of such a block, or one text.
PART_BUCKETS, BLOCK_WORDS = 1 << 19, 1 << 19
#: Parts that a table has at least, so that they spread evenly over the tasks, unless they have fewer than SMALL_PART buckets.
LEAST_PARTS, SMALL_PART = 1 << 8, 1 << 16
#: Leading bits of a count that the histogram of counts keeps.
PRECISION = 8
MASS = 20.0
FLUSH = 1_000_000


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Word hashes, text numbers, number of texts."""
    data, offs = words.text_bytes(column)
    low = words.LOWER[data]
    starts, ends, doc = words.spans(low, offs)
    return words.hashes(low, starts, ends), doc, len(offs) - 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of all words of docs (text) and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for part in words.slices(batch, 0):
                k, n = np.unique(_hashed(part.column(0))[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                size += len(k)
                if size > FLUSH:
                    k, n = merged()
                    keys, counts, size = [k], [n], len(k)
                    if size > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["word", "n"])
                        keys, counts, size = [], [], 0
        if keys:
            k, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Models:
    """Counts of the target (0) and background (1) model over one vocabulary."""

    vocab: np.ndarray  # sorted word hashes
    unigram: np.ndarray  # 2 x (vocabulary and the unknown word)
    context: np.ndarray  # 2 x (the same and the start)
    bigram: np.ndarray  # 2 x buckets of this part
    first: int  # the part's first bucket
    buckets: int  # of all parts


def sized(tokens: int, share: int, least: int, most: int) -> int:
    """The power of two that one entry in `share` tokens needs, within bounds."""
    return min(most, max(least, 1 << max(0, -(-tokens // share) - 1).bit_length()))


def part_width(buckets: int, most: int) -> int:
    """Buckets of a part. A task has the parts that hashing deals it: a few large ones may meet in one, many small ones do not."""
    return min(buckets, most, max(SMALL_PART, buckets // LEAST_PARTS))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(word): those of (word, n) that occur most, size at most; told by a histogram of n, so no task sorts them.

    Words whose counts have equal leading bits are taken together or not at all.
    """
    drop = F.greatest(F.lit(0), F.length(F.bin("n")) - PRECISION)
    floor = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), drop), drop)
    # the leading bits of a 64-bit number: some thousand rows at most
    bars = sorted(counts.groupBy(floor.alias("n")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["n"])
    least, held = None, 0
    for r in bars:
        held += r["words"]
        if held > size:
            break
        least = r["n"]
    return counts.where(F.col("n") >= F.lit(least) if least is not None else F.lit(False)).select("word")


def word_ids(h: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    n = len(vocab)
    if not n:
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocab, h), n - 1)
    return np.where(vocab[at] == h, at, n)


def chained(ids: np.ndarray, doc: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids before those of a vocabulary of n words, and buckets of both."""
    before = np.empty_like(ids)
    if len(ids):
        before[0] = n + 1
        before[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], n + 1)
    return before, (words.mix(before.astype(np.uint64) * np.uint64(n + 2) + ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def encode(h: np.ndarray, doc: np.ndarray, vocab: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, the ids before them, and buckets of both."""
    ids = word_ids(h, vocab)
    return ids, *chained(ids, doc, len(vocab), buckets)


def shape(docs: DataFrame, scratch: Scratch, most_words: int) -> tuple[np.ndarray, int]:
    """The vocabulary, sorted, and the number of buckets that docs (text) ask for."""
    counts = scratch.save(word_counts(docs), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    top = vocabulary(counts, sized(tokens, WORD_SHARE, LEAST_WORDS, most_words)).toArrow()
    vocab = np.sort(np.asarray(top.column(0).combine_chunks()).view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64)
    return vocab, sized(tokens, BUCKET_SHARE, LEAST_BUCKETS, 1 << 62)


def _dense(cells: DataFrame, start: int, width: int) -> np.ndarray:
    """2 x width counts of (cell, t, b)."""
    got = cells.where(F.col("cell").between(start, start + width - 1)).toArrow()  # a row a cell at most
    flat = np.zeros((2, width), np.float64)
    for i in (0, 1):
        flat[i, np.asarray(got.column(0)) - start] = np.asarray(got.column(1 + i))
    return flat


def fit(docs: DataFrame, scratch: Scratch, most_words: int = MOST_WORDS, most_buckets: int = MOST_BUCKETS) -> Iterator[Models]:
    """docs: text, target (boolean, not null). The models, with one part of the table after the other, for callers that want them; score needs no table."""
    vocab, buckets = shape(docs, scratch, most_words)
    n = len(vocab)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    bases = [0, n + 1, 2 * n + 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            """Cells, and twice their counts' sums: 2 x cells."""
            k, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return k, np.stack([np.bincount(back, np.concatenate([t[s] for _, t in held]), len(k)).astype(np.int64) for s in (0, 1)])

        def out(k: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (k, *t)], names=["cell", "t", "b"])

        for batch in batches:
            for part in words.slices(batch, 0):
                h, doc, _ = _hashed(part.column(0))
                if len(h):
                    other = np.where(np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool), 0, 1)[doc]
                    for base, own in zip(bases, encode(h, doc, sent.value, buckets)):
                        cells, times = np.unique(2 * own + other, return_counts=True)
                        held.append((base + cells // 2, np.where(cells % 2 == [[0], [1]], times, 0)))
                        size += len(cells)
                if size > FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    cells = docs.select("text", "target").mapInArrow(run, "cell long, t long, b long").groupBy("cell").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    cells = scratch.save(cells, "models")

    unigram, context = _dense(cells, 0, n + 1), _dense(cells, n + 1, n + 2)
    width = min(buckets, most_buckets)
    for first in range(0, buckets, width):
        yield Models(vocab, unigram, context, _dense(cells, bases[2] + first, min(width, buckets - first)), first, buckets)


@dataclass
class Frame:
    """What every task has of the models: all but the counts of bigrams."""

    vocab: np.ndarray  # sorted word hashes
    buckets: int
    width: int  # of a part
    unigram: np.ndarray | None = None  # as in Models
    context: np.ndarray | None = None


def losses(frame: Frame, ids: np.ndarray, doc: np.ndarray, target: np.ndarray, bucket: np.ndarray, before: np.ndarray, bigram: np.ndarray) -> np.ndarray:
    """2 x words: the loss of each word under the target and the background model. bigram: 2 x words, the counts of the words' buckets."""

    def own(x: np.ndarray) -> np.ndarray:
        """How often the word's document has the word's x."""
        _, back, count = np.unique(doc * np.int64(1 << 32) + x, return_inverse=True, return_counts=True)
        return count[back]

    whole = np.bincount(doc)[doc] if len(doc) else doc
    mine = [own(ids), own(before), own(bucket)]
    out = np.empty((2, len(ids)))
    all_ = frame.unigram.sum(axis=1, dtype=np.float64)
    for s in (0, 1):
        out_of = (target[doc] == (s == 0)).astype(np.int64)
        # the larger model's counts, in units that give it as many tokens as the smaller
        unit = min(1.0, all_[1 - s] / all_[s]) if all_.all() else 1.0
        uni, con, bi = (unit * (c.astype(np.float64) - out_of * m) for c, m in zip((frame.unigram[s][ids], frame.context[s][before], bigram[s]), mine))
        low = (uni + 1.0) / (unit * (all_[s] - out_of * whole) + len(frame.vocab) + 1.0)
        out[s] = -np.log((np.minimum(bi, con) + MASS * low) / (con + MASS))
    return out


def _distinct(bucket: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets in order, and 2 x their counts in targets and others."""
    kept, back = np.unique(bucket, return_inverse=True)
    return kept, np.stack([np.bincount(back[other == s], minlength=len(kept)) for s in (0, 1)]).astype(np.int32)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([x.astype(np.int32).tobytes()], pa.binary())


def blocks(rows: DataFrame, frame: Broadcast, id_type: str) -> DataFrame:
    """rows (text, target, doc_id) in three kinds of rows, by `part`.

    -1: a block of documents (ids: of all words; sizes: words of each document). 0 and more: the buckets of a
    block in this part of the table (at: from the part's first), with their counts (t, b). -2: how often a
    cell, a word or n + 1 and a word before another, occurs in the task's documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, buckets, width = len(frame.value.vocab), frame.value.buckets, frame.value.width
        cells = np.zeros((2, 2 * n + 3), np.int64)
        number = TaskContext.get().partitionId() << 32
        held, size, schema = [], 0, None

        def put(rows: int, **made: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def block() -> Iterator[pa.RecordBatch]:
            ids, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            target, doc_id = (pa.concat_arrays([x[i] for x in held]) for i in (2, 3))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            other = np.where(np.asarray(target.to_numpy(zero_copy_only=False), bool), 0, 1)[doc]
            before, bucket = chained(ids, doc, n, buckets)
            for s in (0, 1):
                cells[s] += np.bincount(ids[other == s], minlength=2 * n + 3) + np.bincount(before[other == s] + n + 1, minlength=2 * n + 3)
            key, whole = pa.array([number], pa.int64()), pa.array([0, len(sizes)], pa.int32())
            yield put(1, block=key, part=pa.array([-1], pa.int32()), ids=_packed(ids), sizes=_packed(sizes), targets=pa.ListArray.from_arrays(whole, target), doc_ids=pa.ListArray.from_arrays(whole, doc_id))
            kept, times = _distinct(bucket, other)
            part = kept // width
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(kept)] if len(kept) else []
            for a, b in zip(cuts, cuts[1:]):
                yield put(1, block=key, part=pa.array([part[a]], pa.int32()), at=_packed(kept[a:b] - part[a] * width), t=_packed(times[0, a:b]), b=_packed(times[1, a:b]))

        for batch in batches:
            if schema is None:
                some = [("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("at", "t", "b", "ids", "sizes"))]
                schema = pa.schema([*some, ("targets", pa.list_(batch.column(1).type)), ("doc_ids", pa.list_(batch.column(2).type)), *((c, pa.int64()) for c in ("cell", "n_t", "n_b"))])
            for piece in words.slices(batch, 0):
                h, doc, rows_ = _hashed(piece.column(0))
                held.append((word_ids(h, frame.value.vocab), np.bincount(doc, minlength=rows_) if len(doc) else np.zeros(rows_, np.int64), piece.column(1), piece.column(2)))
                size += len(h) + rows_
                if size >= BLOCK_WORDS:
                    yield from block()
                    number, held, size = number + 1, [], 0
        if held:
            yield from block()
        found = np.flatnonzero(cells.any(axis=0))
        for at in range(0, len(found), 100_000):
            some = found[at : at + 100_000]
            yield put(len(some), part=pa.array(np.full(len(some), -2), pa.int32()), cell=pa.array(some), n_t=pa.array(cells[0, some]), n_b=pa.array(cells[1, some]))

    kinds = f"block long, part int, at binary, t binary, b binary, ids binary, sizes binary, targets array<boolean>, doc_ids array<{id_type}>, cell long, n_t long, n_b long"
    return rows.mapInArrow(run, kinds)


def _counts(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of packed rows, end to end."""
    return np.concatenate([np.frombuffer(x, np.int32) for x in column.to_pylist()] or [np.zeros(0, np.int32)])


def sums(asked: DataFrame, width: int) -> DataFrame:
    """(block, part, at, t, b) with the sums over all blocks for t and b, in 64 bits; at is left out."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros((2, width), np.int64)
        rows = lambda *names: zip(*([np.frombuffer(x.as_buffer(), np.int32) for x in table.column(c)] for c in names))  # noqa: E731  views, no copies
        for at, *times in rows("at", "t", "b"):
            for s in (0, 1):
                total[s][at] += times[s]  # a row's buckets are distinct
        out = [pa.array([total[s][at].tobytes() for (at,) in rows("at")], pa.binary()) for s in (0, 1)]
        return pa.table([table.column("block"), table.column("part"), *out], names=["block", "part", "t", "b"])

    return asked.groupBy("part").applyInArrow(run, "block long, part int, t binary, b binary")


def score(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS, most_buckets: int = PART_BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of each row; a lower score is more like the target.

    targets: a column doc_id. The losses and their difference, the score, are means a token, in nats.
    most_buckets: of a part of the table; it has no part in the result.
    """
    scratch, context = Scratch(docs.sparkSession, "lmscore"), docs.sparkSession.sparkContext
    ids = scratch.save(targets.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct(), "targets").withColumn("_t", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select("text", F.coalesce("_t", F.lit(False)).alias("target"), "doc_id")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    vocab, buckets = shape(rows, scratch, most_words)
    n, width = len(vocab), part_width(buckets, most_buckets)
    made = scratch.save(blocks(rows, context.broadcast(Frame(vocab, buckets, width)), id_type), "blocks")
    cells = scratch.save(made.where("part = -2").groupBy("cell").agg(F.sum("n_t").alias("t"), F.sum("n_b").alias("b")), "cells")
    sent = context.broadcast(Frame(vocab, buckets, width, _dense(cells, 0, n + 1), _dense(cells, n + 1, n + 2)))
    told = scratch.save(sums(made.where("part >= 0").select("part", "block", "at", "t", "b"), width), "sums")

    def run(documents: pa.Table, found: pa.Table) -> pa.Table:
        """Of one block."""
        frame, found = sent.value, found.sort_by("part")
        word, sizes = _counts(documents.column("ids")).astype(np.int64), _counts(documents.column("sizes"))
        target = np.asarray(documents.column("targets").combine_chunks().flatten().to_numpy(zero_copy_only=False), bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        before, bucket = chained(word, doc, len(frame.vocab), frame.buckets)
        back = np.unique(bucket, return_inverse=True)[1]
        bigram = [np.concatenate([np.frombuffer(x, np.int64) for x in found.column(c).to_pylist()] or [np.zeros(0, np.int64)])[back] for c in ("t", "b")]
        each = losses(frame, word, doc, target, bucket, before, bigram)
        mean = [np.bincount(doc, each[s], len(sizes)) / np.maximum(sizes, 1) for s in (0, 1)]
        cols = [pa.array(x, mask=sizes == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.table([documents.column("doc_ids").combine_chunks().flatten(), pa.array(sizes.astype(np.int64)), *cols], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    texts = made.where("part = -1").select("block", "ids", "sizes", "targets", "doc_ids")
    both = texts.groupBy("block").cogroup(told.groupBy("block"))
    return both.applyInArrow(run, f"doc_id {id_type}, n_tokens long, loss_target double, loss_background double, score double")
