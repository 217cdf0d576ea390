"""Hard negatives by blocked dense products: for each anchor and positive, the closest rows of another label.

Vectors are whole numbers, so a product of blocks in float64 is exact while no sum
can reach 2**53; blocks that could reach it are multiplied in Python's whole numbers
instead. The anchors are a stated part of the rows. They are dealt into groups of
`GROUP` numbers' worth of vectors; a group is sent to all tasks (its size is bounded
and known), and every task multiplies it block by block with its own rows:

1. a task keeps, for each anchor, the best rows of the anchor's label that it saw. Such
   lists merge: the tasks' lists meet by anchor, and the best of them are its positives;
2. with the positives' scores, each (anchor, positive) has a window of scores. A task
   keeps the best rows of other labels in each window, and these lists merge likewise.

A task hands on at most k rows for each list, whatever it read; memory is one block of
scores and the lists of a group. A group's lists are tables in the shared folder, so a
lost executor costs its tasks.

Higher scores come first, ties by smaller id. Edges: rows with a null id, label or
vector, or a null or non-finite component take no part. Rows with an anchor's own id
aren't its partners; else each row stands for itself, so a repeated row may fill several
places, and a repeated anchor has its own result each time. Vectors of unequal length
have no score. A positive without a row in its window has no row in the result. A score
beyond 64 bits is an error. An empty table, or one without anchors, gives an empty table; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.storage import Scratch

#: Numbers in the vectors of one group of anchors: 32 MB.
GROUP = 1 << 22
#: Anchors, and numbers in the rows, of one product.
ANCHORS, NUMBERS = 512, 1 << 18
EXACT = 2**53
LEAST, LAST = -(2**63), 2**63 - 1


class Best:
    """The k best (score, id) of each of n lists; higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), LEAST), np.full((n, k), LAST)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """Take in a block: a row of scores for each list from `first`, the masked ones only; ids ascend."""
        k, n = self.score.shape[1], len(scores)
        bound, worst = self.score[first : first + n, -1:], self.id[first : first + n, -1:]
        if scores.dtype == np.float64:
            bound = bound.astype(np.float64)
        better = scores > bound
        if len(ids) and ids[0] < worst.max():
            better |= (scores == bound) & (ids < worst)
        better &= mask
        many = np.flatnonzero(np.count_nonzero(better, axis=1) > 4 * k)
        if len(many):
            own = np.where(better[many], scores[many], scores.dtype.type(LEAST))
            kth = np.partition(own, -k, axis=1)[:, -k, None]
            ties = better[many] & (own == kth)
            better[many] &= (own > kth) | (ties & (np.cumsum(ties, axis=1) <= k))  # the first k of a tie have the least ids
        row, column = np.nonzero(better)
        if not len(row):
            return
        lists = np.unique(row)
        at = np.concatenate([row, np.repeat(lists, k)])
        score = np.concatenate([scores[row, column].astype(np.int64), self.score[first + lists].ravel()])
        who = np.concatenate([ids[column], self.id[first + lists].ravel()])
        order = np.lexsort((who, -(score + 1), at))  # + 1: the least number has no opposite
        at, score, who = at[order], score[order], who[order]
        begin = np.searchsorted(at, lists)
        pick = begin[:, None] + np.arange(k)
        self.score[first + lists], self.id[first + lists] = score[pick], who[pick]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, score and id of all that is held."""
        at, place = np.nonzero((self.id != LAST) | (self.score != LEAST))
        return at, self.score[at, place], self.id[at, place]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, whole numbers held as float64: exact."""
    most = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if float(most[0]) * float(most[1]) * max(a.shape[1], 1) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    out = whole(a).dot(whole(b).T)
    if any(not LEAST < x <= LAST for x in out.ravel()):
        raise OverflowError("a score has more than 64 bits")
    return out.astype(np.int64)


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    x = F.col("vector")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    # coalesced: a null array makes the test null, and the row goes
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(x.isNotNull() & sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")


def _blocks(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, ids, labels and vectors (floor(scale * x)) of rows of equal length, in blocks, ids ascending."""
    ids, labels, vector = (batch.column(c) for c in range(3))
    ids, labels, begins, flat = np.asarray(ids), np.asarray(labels), np.asarray(vector.offsets), np.asarray(vector.values)
    sizes = np.diff(begins)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        step = max(NUMBERS // max(int(d), 1), 1)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield int(d), ids[part], labels[part], np.floor(scale * flat[begins[part][:, None] + np.arange(d)].astype(np.float64))


class Group:
    """A group of anchors, sorted by the length of their vectors."""

    def __init__(self, table: pa.Table, scale: int):
        parts = [b for batch in table.combine_chunks().to_batches() for b in _placed(batch, scale)]
        self.parts: list[tuple[int, int, np.ndarray]] = []  # length, first anchor, vectors
        rows, ids, labels, n = [], [], [], 0
        for d, row, i, label, m in parts:
            for s in range(0, len(i), ANCHORS):
                self.parts.append((d, n + s, m[s : s + ANCHORS]))
            rows, ids, labels, n = [*rows, row], [*ids, i], [*labels, label], n + len(i)
        self.row, self.id, self.label = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, ids, labels))


def _placed(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """_blocks of a batch (row, vec_id, label, vector), with the rows' numbers."""
    place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2), batch.column(3)], names=["place", "label", "vector"])
    row, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    for d, at, label, m in _blocks(place, scale):
        yield d, row[at], ids[at], label, m


def _scored(group: Group, batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors of each product, its scores, and the ids and labels of its rows."""
    for batch in batches:
        for d, ids, labels, m in _blocks(batch, scale):
            for own, first, a in group.parts:
                if own == d:
                    yield slice(first, first + len(a)), product(a, m), ids, labels


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, vector).

    anchors: which rows are anchors, of vec_id and label. window: percent of the positive's
    score, least and most, that a negative's score may have.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = prepared(vectors)
    chosen = rows.where(anchors)
    size = chosen.agg(F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    groups = max(-(-size // GROUP), 1)
    queries = scratch.save(chosen.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector").withColumn("group", F.col("row") % groups), "anchors")
    out = [_of_group(scratch, rows, queries.where(F.col("group") == g).drop("group"), g, positives, negatives, window, scale) for g in range(groups)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _of_group(scratch: Scratch, rows: DataFrame, queries: DataFrame, g: int, positives: int, negatives: int, window: tuple[int, int], scale: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    group = sc.broadcast(Group(queries.toArrow(), scale))  # GROUP numbers or a little more
    n = len(group.value.id)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = group.value
        best = Best(len(own.id), positives)
        for part, scores, ids, labels in _scored(own, batches, scale):
            best.add(part.start, scores, ids, (own.label[part, None] == labels) & (own.id[part, None] != ids))
        at, score, who = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(who), pa.array(score)], names=["anchor", "positive_id", "positive_score"])

    first = lambda by, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(f"{k}_score").desc(), f"{k}_id"))
    found = rows.mapInArrow(same, "anchor long, positive_id long, positive_score long").withColumn("place", first(["anchor"], "positive")).where(F.col("place") <= positives)
    found = scratch.save(found, f"positives-{g}")

    # one list for each anchor and positive; at most `positives` times the anchors of a group
    held = found.toArrow()
    anchor, place, who, score = (np.asarray(held.column(c).combine_chunks()).astype(np.int64) for c in ("anchor", "place", "positive_id", "positive_score"))
    low, high, partner = np.ones((positives, n), np.int64), np.zeros((positives, n), np.int64), np.zeros((positives, n), np.int64)
    whole, least, most = np.zeros((positives, n), np.int64), *window
    whole[place - 1, anchor], partner[place - 1, anchor] = score, who
    low[place - 1, anchor] = [-(-least * int(p) // 100) for p in score]
    high[place - 1, anchor] = [most * int(p) // 100 for p in score]
    windows = sc.broadcast((low, high, partner, whole))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (lows, highs, partners, wholes) = group.value, windows.value
        best = [Best(len(own.id), negatives) for _ in range(positives)]
        for part, scores, ids, labels in _scored(own, batches, scale):
            apart = own.label[part, None] != labels
            for j in range(positives):
                best[j].add(part.start, scores, ids, apart & (scores >= lows[j, part, None]) & (scores <= highs[j, part, None]))
        for j in range(positives):
            at, score, who = best[j].rows()
            columns = [own.row[at], own.id[at], partners[j, at], np.full(len(at), j), wholes[j, at], who, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score"])

    near = rows.mapInArrow(other, "row long, anchor_id long, positive_id long, place long, positive_score long, negative_id long, negative_score long")
    near = near.withColumn("rank", first(["row", "place"], "negative")).where(F.col("rank") <= negatives)
    near = scratch.save(near.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"negatives-{g}")
    group.unpersist()
    windows.unpersist()
    return near
