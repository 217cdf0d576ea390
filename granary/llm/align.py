"""Where the tokens of two tokenizers lie over the same bytes, and which tokens stand for which.

A text's bytes each have an owner among the tokens of A and one among those of B:
`np.repeat` of the tokens' numbers over their lengths. From byte to byte, consecutive
distinct pairs of owners are the overlaps of tokens, and where both owners change at
once there is a cut. Cuts divide the tokens into groups, the smallest stretches that
both tokenizers cover with whole tokens. All tokens of A and B in a group are linked.

`aligned` gives tokens, groups and overlaps. `report` adds how often the corpus links two
ids. Documents are aligned once, in blocks of bounded size; a block keeps its documents'
links as numbers into its own sorted list of distinct pairs. Only those lists are
shuffled: counts are summed by pair, joined to the lists by pair, and each block meets
its own counts. So what is shuffled is distinct pairs of blocks, not links of documents,
and no table of all pairs goes to a task. The highest count of an id of A is one of a table of
at most A's vocabulary, which is sent to all tasks.

A (byte-level BPE) reads a space and the text, B (SentencePiece) the text, to which it
adds the space itself; strings of special tokens are ordinary text.

Edges: null and empty texts have no tokens, and neither do texts whose tokens' bytes
aren't the space and the text (B reads U+2581 as a space): all numbers are 0 and strings
empty. Each row is a document of its own, repeated ids and rows too, and counts as one.
Counts that tie for the highest are all highest. Very long texts, and groups of any size, are
taken whole: a long group's links are counted by its distinct ids. An empty table gives an
empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import pieces, tokens
from granary.llm.storage import Scratch
from granary.llm.words import slices

#: Bytes of text aligned at once, and links (distinct pairs of a document) of a block.
SLICE, BLOCK = 1 << 20, 1 << 21
#: Groups with more links than this are counted by distinct ids.
MANY = 1 << 10


class Readers:
    """Both tokenizers, the bytes of their ids, and the ids' decimal digits."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_size = tokens.load(a_path)
        model = pieces.load(b_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes, self.b_size = model.bytes, np.array([len(x) for x in model.bytes], np.int64)
        # two ids make one number of 64 bits
        self.b_bits = int(len(self.b_size) - 1).bit_length()
        self.bits = self.b_bits + int(len(self.a_size) - 1).bit_length()
        n = max(len(self.a_size), len(self.b_size))
        text = [str(i).encode() for i in range(n)]
        self.digits = np.frombuffer(b"".join(t.ljust(len(str(n)) + 1, b"\0") for t in text), np.uint8).reshape(n, -1)
        self.n_digits = np.array([len(t) for t in text])

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B; none if their bytes aren't a space and the text."""
        if text:
            a, b = tokens.encode(self.a, " " + text), self.b.encode(text, out_type=int)
            raw = (" " + text).encode()
            if self.a_size[a].sum() == len(raw) and b"".join([self.b_bytes[i] for i in b]) == raw:
                return a.astype(np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Readers:
    return Readers(a_path, b_path)


class Aligned:
    """The tokens of some documents, end to end, and how they lie over each other."""

    def __init__(self, readers: Readers, texts: list[str | None]):
        self.readers = readers
        both = [readers.read(t) for t in texts]
        none = np.zeros(0, np.int64)
        self.a, self.b = (np.concatenate([x[s] for x in both] or [none]) for s in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[s]) for x in both], np.int64) for s in (0, 1))
        size_a, size_b = readers.a_size[self.a], readers.b_size[self.b]
        #: Of each byte: the number of its token of A, and of B.
        owner_a, owner_b = (np.repeat(np.arange(len(s), dtype=np.int32), s) for s in (size_a, size_b))
        new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        cut = new_a & new_b
        group = np.concatenate([[0], np.cumsum(cut)])[: len(owner_a)]
        self.first_a, self.first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b  # bytes
        self.group_a, self.group_b = group[self.first_a], group[self.first_b]
        n = int(group[-1]) + 1 if len(group) else 0
        #: Of each group: number of tokens, first token, first byte, document.
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.from_a, self.from_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.doc = doc_a[self.from_a]
        self.begin = self.first_a[self.from_a]
        self.n_groups = np.bincount(self.doc, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
        # overlaps: where a pair of owners begins
        at = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1]) if len(owner_a) else none
        self.over_a, self.over_b = owner_a[at].astype(np.int64), owner_b[at].astype(np.int64)
        self.over_bytes = np.diff(np.append(at, len(owner_a)))
        self.over_doc = doc_a[self.over_a]

    def spelled(self) -> list[str]:
        """SHA-256 of each document's groups, spelled `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        r = self.readers
        place_a = np.arange(len(self.a)) + self.from_b[self.group_a]
        place_b = np.arange(len(self.b)) + (self.from_a + self.in_a)[self.group_b]
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[self.from_a + self.in_a - 1]] = ord("|")
        after[place_b[self.from_b + self.in_b - 1]] = ord(";")
        rows, n = r.digits[ids], r.n_digits[ids]
        rows[np.arange(len(ids)), n] = after
        flat = rows[np.arange(rows.shape[1]) <= n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair of ids and number of links, sorted: each pair of a document once."""
        r, many = self.readers, self.in_a * self.in_b > MANY
        few = ~many[self.group_a]
        times = np.where(few, self.in_b[self.group_a], 0)
        own = np.repeat(np.arange(len(self.a)), times)  # the token of A of each link
        nth = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        other = self.from_b[self.group_a[own]] + nth
        key = (self.doc[self.group_a[own]] << r.bits) | (self.a[own] << r.b_bits) | self.b[other]
        keys, weights = [key], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(many):
            xs, nx = np.unique(self.a[self.from_a[g] : self.from_a[g] + self.in_a[g]], return_counts=True)
            ys, ny = np.unique(self.b[self.from_b[g] : self.from_b[g] + self.in_b[g]], return_counts=True)
            keys.append(((self.doc[g] << r.bits) | (xs[:, None] << r.b_bits) | ys).ravel())
            weights.append((nx[:, None] * ny).ravel())
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return key[first] >> r.bits, key[first] & ((1 << r.bits) - 1), np.add.reduceat(weight, first) if len(first) else weight

    def n_links(self) -> np.ndarray:
        return np.bincount(self.doc, self.in_a * self.in_b, len(self.n_a)).astype(np.int64)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or tokens.default_path(), b_path or pieces.default_path()


def _ragged(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, groups, overlaps) of each text, after the space.

    groups: first byte, and the numbers of the tokens of A and B in each group, in order.
    overlaps: numbers of two tokens of the document, and of the bytes that they share.
    """
    a_path, b_path = _paths(a_path, b_path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = load(a_path, b_path)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                x = Aligned(readers, part.column(1).to_pylist())
                n = part.num_rows
                start_a, start_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                start = np.zeros(n, np.int64)
                lead = np.concatenate([[True], x.doc[1:] != x.doc[:-1]]) if len(x.doc) else np.zeros(0, bool)
                start[x.doc[lead]] = x.begin[lead]
                groups = pa.StructArray.from_arrays([pa.array((x.begin - start[x.doc]), pa.int64()), pa.array(x.in_a, pa.int32()), pa.array(x.in_b, pa.int32())], ["byte", "n_a", "n_b"])
                overlaps = pa.StructArray.from_arrays([pa.array(x.over_a - start_a[x.over_doc], pa.int32()), pa.array(x.over_b - start_b[x.over_doc], pa.int32()), pa.array(x.over_bytes, pa.int32())], ["a", "b", "bytes"])
                yield pa.RecordBatch.from_arrays([part.column(0), _ragged(x.n_a, pa.array(x.a, pa.int32())), _ragged(x.n_b, pa.array(x.b, pa.int32())), _ragged(x.n_groups, groups), _ragged(np.bincount(x.over_doc, minlength=n), overlaps)], names=["doc_id", "a_ids", "b_ids", "groups", "overlaps"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<byte:long,n_a:int,n_b:int>>, overlaps array<struct<a:int,b:int,bytes:int>>")


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<i4").tobytes() for c in columns))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").astype(np.int64)
    return [flat[i : i + n] for i in range(0, len(flat), n)] if n else [flat, flat]


class _Block:
    """Documents until their links are enough for a row of `blocks`."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self) -> None:
        self.ids, self.numbers, self.spelled, self.sizes, self.pairs, self.times = [], [], [], [], [], []
        self.n = 0

    def add(self, ids: pa.Array, x: Aligned) -> None:
        doc, pair, times = x.links()
        self.ids.append(ids)
        self.numbers.append(np.stack([x.n_a, x.n_b, x.n_groups, x.n_links()]))
        self.spelled += x.spelled()
        self.sizes.append(np.bincount(doc, minlength=len(ids)))
        self.pairs.append(pair)
        self.times.append(times)
        self.n += len(pair)

    def row(self, number: int) -> pa.RecordBatch:
        pair = np.concatenate(self.pairs)
        distinct, place = np.unique(pair, return_inverse=True)
        # pairs ascend within a document, so the steps between their places are small
        steps = np.diff(place, prepend=0)
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        numbers = [one(pa.array(c, pa.int64())) for c in np.concatenate(self.numbers, axis=1)]
        columns = [pa.array([number]), one(pa.concat_arrays(self.ids)), *numbers, one(pa.array(self.spelled, pa.string())), one(pa.array(np.concatenate(self.sizes), pa.int32())),
                   pa.array([_pack(steps, np.concatenate(self.times))], pa.binary()), one(pa.array(distinct, pa.int64())), one(pa.array(np.bincount(place, minlength=len(distinct)), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", *self.NUMBERS, "groups_sha256", "sizes", "links", "pairs", "docs"])


def blocks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a block of documents: their figures, their links, and the block's distinct pairs with the number of its documents that link them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers, block, number = load(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                block.add(part.column(0), Aligned(readers, part.column(1).to_pylist()))
                if block.n >= BLOCK:
                    yield block.row(number)
                    block, number = _Block(), number + 1
        if block.ids:
            yield block.row(number)

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} array<long>" for c in _Block.NUMBERS)
    return rows.mapInArrow(run, f"block long, doc_id array<{kind}>, {numbers}, groups_sha256 array<string>, sizes array<int>, links binary, pairs array<long>, docs array<int>")


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    The count of a pair of ids is the number of documents that link it. n_best: links whose
    count is the highest of their id of A; count_sum: the sum over links.
    """
    a_path, b_path = _paths(a_path, b_path)
    scratch, b_bits = Scratch(docs.sparkSession, "align"), load(a_path, b_path).b_bits
    own = scratch.save(blocks(docs, a_path, b_path, doc_id, text), "blocks")
    held = own.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", "x.pairs", "x.docs")
    counts = scratch.save(held.groupBy("pairs").agg(F.sum("docs").alias("count")), "counts")
    most = counts.groupBy(F.shiftright("pairs", b_bits).alias("a")).agg(F.max("count").alias("most"))  # A's vocabulary at most
    ranked = counts.join(F.broadcast(most), F.shiftright("pairs", b_bits) == F.col("a")).select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    back = held.select("block", "pairs").join(ranked, "pairs").select(F.col("block").alias("of"), "pairs", "count", "best")
    kind = docs.schema[doc_id].dataType.simpleString()

    def settle(mine: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        found = found.sort_by("pairs")
        count, best = np.asarray(found["count"]), np.asarray(found["best"])
        for row in mine.combine_chunks().to_batches():
            sizes = np.asarray(row.column("sizes")[0].values)
            ends = np.cumsum(sizes)
            steps, times = _unpack(row.column("links")[0].as_py(), int(ends[-1]))
            place = np.cumsum(steps)
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
            columns = {c: row.column(c)[0].values for c in ("doc_id", *_Block.NUMBERS, "groups_sha256")}
            sums = [pa.array(total(times * best[place]), pa.int64()), pa.array(total(times * count[place]), pa.int64())]
            out.append(pa.table([*[columns[c] for c in ("doc_id", *_Block.NUMBERS)], *sums, columns["groups_sha256"]], names=["doc_id", *_Block.NUMBERS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(settle, schema)
