"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so the range-sorted documents, and
likewise the range-sorted gaps of open sequences, are at most `capacity` runs of
equal rows. A round takes the longest unplaced run of documents and sweeps to its
successor, the smallest gap that is long enough. The documents of the run and the
sequences of that gap meet by rank: rank i goes to gap i, the ranks beyond the
shorter side wait, the gaps used shrink, and the next round begins. Where no gap is
long enough, just enough sequences are opened. This is best-fit decreasing, whole
runs at a time; the state is counts by length, whatever the number of rows.

The rows themselves then meet their places in one pass: each piece gets its rank
among pieces of its length (ranked in salted groups, so a length that many pieces
have is no single task's work) and looks up the successor of that rank in the
placements of its length.

Edges: a null text is empty, and an empty document is the closing id alone. Strings of
special tokens in a text are those tokens, as the tokenizer reads them by default. Each
row is a document of its own, repeated ids and rows too. Ties in length go by
doc_id and piece. A very long text is encoded whole. doc_id may have any type. An
empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import tokens
from granary.llm.storage import Scratch

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks; a length with more is dealt to as many groups as that takes.
RANK_GROUP = 1024


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity if there are several."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _ids(encoder, text: str | None, special: bool = True) -> np.ndarray:
    return np.append(tokens.encode(encoder, text or "", special), np.uint32(END_ID)).astype("<u4")


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False, special: bool = True) -> DataFrame:
    """The pieces of docs (doc_id, text): place in the document, length, checksum and, if asked for, ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = tokens.load(path)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                own = _ids(encoder, text.as_py(), special)
                for k, (s, n) in enumerate(cut(len(own), capacity)):
                    part = own[s : s + n]
                    rows.append((i, k, s, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                if len(rows) >= 4096:
                    yield _batch(batch.column(0), rows)
                    rows = []
            yield _batch(batch.column(0), rows)

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1 : len(names)], types)]], names=names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(sizes: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Placements of each length: first ranks, first sequences and offsets, in order of rank.

    The document of rank r, in the placement that begins at rank f with sequence b,
    goes to sequence b + r - f.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, number)
    order: list[int] = []  # the gaps that have runs, ascending
    opened = 0
    out = {}

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append(run)

    for length in sorted(sizes, reverse=True):
        left, rank, placed = sizes[length], 0, []
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                new = -(-left // (capacity // length))
                put(capacity, (opened, new))
                opened += new
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            used = min(left, number)
            placed.append((rank, first, capacity - gap))
            rank, left = rank + used, left - used
            if number > used:
                put(gap, (first + used, number - used))
            put(gap - length, (first, used))
        out[length] = tuple(np.array(c, np.int64) for c in zip(*placed))
    return out


def ranked(rows: DataFrame, sizes: dict[int, int], group: int = RANK_GROUP) -> DataFrame:
    """rows with `rank`, from 0, among rows of their length. A length's rows are ranked in groups of about `group`."""
    spark = rows.sparkSession
    # a row for each length that is more than one group: no more than the capacity
    salts = spark.createDataFrame([(n, -(-count // group)) for n, count in sizes.items() if count > group], "at long, groups long")
    salted = rows.join(F.broadcast(salts), F.col("length") == F.col("at"), "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("groups", F.lit(1).cast("long"))).cast("int")).drop("at", "groups")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = salted.withColumn("own", F.row_number().over(within) - 1)
    return own.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "base", "own")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """One row a piece: its document, its place there, its sequence and its offset in that. special=False: strings of special tokens are ordinary text."""
    path = path or tokens.default_path()
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.save(pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), capacity, path, special=special), "pieces")
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    sent = docs.sparkSession.sparkContext.broadcast(plan(sizes, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                first, base, off = sent.value[n]
                at = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[at] + rank[mine] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(rows, sizes).mapInArrow(place, schema)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: bool = True) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. Needs distinct, non-null doc_ids, and `special` as it was."""
    own = pieces(docs.select("doc_id", "text"), capacity, path or tokens.default_path(), with_ids=True, special=special).select("doc_id", "piece", "ids")
    rows = packed.select("doc_id", "piece", "sequence_id", "offset").join(own, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
