"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact similarity.

A document's windows have as many words as a benchmark item. Each window, and each
item, has the multiset of its word shingles and a 64-bit SimHash of it, weighted by
multiplicity. A multi-index of the items' fingerprints is probed with the window's:
of BLOCKS blocks of 8 bits, two fingerprints within RADIUS share one that differs
in RADIUS // BLOCKS bits at most, so no fingerprint within the radius is missed. A
pair that passes is a leak if the weighted Jaccard similarity of the two multisets,
sum of minima over sum of maxima, reaches the threshold. At a similarity of 0.8 the
fingerprints lie 10 bits apart on average, and beyond 23 bits in 2 of a million cases.

A window without any of the items' shingles has similarity 0 to all of them; only
windows with one are fingerprinted, all of them, at every offset.

The benchmark is read in blocks of bounded bytes, one pass over the documents for
each, so what is sent to a task does not grow with the benchmark.

Edges: words are runs of letters, digits and non-ASCII characters, lower-cased, so
case and punctuation don't hide a leak. A null or empty text, and an item of
fewer than SHINGLE words, match nothing; a document shorter than an item is one
window. Items with equal text all leak. Rows are independent, so repeated rows give
repeated results. Ties between windows go to the first. Very long texts are looked at in
stretches of STRETCH words. Other columns, whatever their names, are carried
(keep_clean) or ignored (find). Empty tables give empty ones.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words

SHINGLE = 5
LEAST = 0.8
RADIUS = 23
BLOCKS = 8
BLOCK_BYTES = 16 << 20
#: Words, or pairs of a window and an item, that are looked at together: they bound the memory of a text of any length.
STRETCH = 1 << 14
PAIRS = 1 << 24
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_FILTER_BITS = 20


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash at the first word of each shingle, elsewhere 0; and the first word of each text."""
    data, offs = words.text_bytes(pc.utf8_lower(column))
    starts, ends, doc = words.spans(data, offs, words.IS_BREAK)
    h = words.hashes(data, starts, ends)
    out = np.zeros(len(h), np.uint64)
    m = len(h) - SHINGLE + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(SHINGLE):
            acc = words.mix(acc + h[j : j + m])
        out[:m] = np.where(doc[:m] == doc[SHINGLE - 1 :], acc, 0)
    return out, np.searchsorted(doc, np.arange(len(offs)))


def fingerprints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64 bits, as bytes, of the windows of `length` shingles at the starts."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(2 * (total[starts + length] - total[starts]) >= length, axis=1, bitorder="little")


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """A block of benchmark items, by their number of words."""

    def __init__(self, texts: list[str | None]):
        sh, first = _shingles(pa.array(texts, pa.string()))
        self.items: list[Counter] = []
        by_size: dict[int, list[int]] = defaultdict(list)
        prints, pairs = [], []
        for i, (a, b) in enumerate(zip(first, first[1:])):
            own = sh[a : b - SHINGLE + 1] if b - a >= SHINGLE else sh[:0]
            self.items.append(Counter(own.tolist()))
            if len(own):
                prints.append(fingerprints(own, np.array([0]), len(own))[0])
                by_size[b - a].append(i)
                pairs += [(x, b - a) for x in self.items[-1]]
            else:
                prints.append(np.zeros(8, np.uint8))
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        self.of_size = {n: np.array(x) for n, x in by_size.items()}
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        self.tables = {n: [near[:, self.prints[x, b]] for b in range(BLOCKS)] for n, x in self.of_size.items()}
        pairs = sorted(set(pairs))
        key = np.array([p[0] for p in pairs], np.uint64)
        self.known, self.at = np.unique(key, return_index=True)  # shingles, and where each one's sizes begin
        self.at = np.append(self.at, len(pairs))
        self.sizes = np.array([p[1] for p in pairs], np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) pairs within RADIUS, found by the blocks."""
        items, tables, out = self.of_size[size], self.tables[size], []
        step = max(1, PAIRS // len(items))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            found = tables[0][part[:, 0]].copy()
            for b in range(1, BLOCKS):
                found |= tables[b][part[:, b]]
            w, i = np.nonzero(found)
            close = _POPCOUNT[part[w] ^ self.prints[items[i]]].sum(axis=1) <= RADIUS
            out += zip((w[close] + at).tolist(), items[i[close]].tolist())
        return out

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of each text and item that reach LEAST."""
        sh, first = _shingles(column)
        maybe = np.flatnonzero(self.filter[(sh >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & (sh != 0))
        if not len(maybe) or not len(self.known):
            return []
        k = np.minimum(np.searchsorted(self.known, sh[maybe]), len(self.known) - 1)
        sure = self.known[k] == sh[maybe]
        hits, k = maybe[sure], k[sure]
        n = self.at[k + 1] - self.at[k]
        place = np.repeat(hits, n)
        size = self.sizes[np.repeat(self.at[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.searchsorted(first, place, "right") - 1
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, s, p in zip(doc.tolist(), size.tolist(), place.tolist()):
            groups[d, s].append(p)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (d, s), at in groups.items():
            low, high = int(first[d]), int(first[d + 1])
            long = min(s, high - low)
            own = np.array(at)
            reach = long - SHINGLE
            begin, end = np.maximum(own - reach, low), np.minimum(own, high - long)
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(begin, end)]))
            # stretch by stretch: only what windows cover is fingerprinted, however far apart they lie
            cuts = np.flatnonzero((np.diff(starts) > reach) | (np.diff(starts // STRETCH) > 0)) + 1
            prints = np.concatenate([fingerprints(sh[x[0] : x[-1] + reach + 1], x - x[0], reach + 1) for x in np.split(starts, cuts)])
            seen: dict[int, Counter] = {}
            for w, item in self.candidates(prints, s):
                if w not in seen:
                    x = int(starts[w])
                    seen[w] = Counter(sh[x : x + reach + 1].tolist())
                got = similarity(seen[w], self.items[item])
                if got >= LEAST and (d, item) not in best or (d, item) in best and got > best[d, item][0]:
                    best[d, item] = (got, int(starts[w]) - low, long)
        return [(d, item, *x) for (d, item), x in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[pa.Array, Index]]:
    """Item ids and index of each block of the benchmark; a block has about BLOCK_BYTES of text."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for b in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").toArrow()
        if own.num_rows:
            yield own.column(0).combine_chunks(), Index(own.column(1).to_pylist())


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document and item that leaks."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, similarity double, first_word long, n_words long"
    spark, out = docs.sparkSession, None
    for sent in (spark.sparkContext.broadcast(x) for x in blocks(benchmark, item_id, item_text)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, index = sent.value
            for batch in batches:
                for part in words.slices(batch, 1):
                    got = list(zip(*index.leaks(part.column(1)))) or [()] * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(got[0], pa.int64())), ids.take(pa.array(got[1], pa.int64())), pa.array(got[2], pa.float64()), pa.array(got[3], pa.int64()), pa.array(got[4], pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a leak, all their columns as they are."""
    column = docs.columns.index(text)
    for sent in (docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark, item_id, item_text)):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.slices(batch, column):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in sent.value[1].leaks(part.column(column))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
