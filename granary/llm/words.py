"""Vectorised word splitting and hashing over Arrow string columns.

A word is a longest run of bytes outside space, \\t, \\n, \\v, \\f, \\r; all other
bytes, whatever the script, belong to words. Work goes over slices of bounded
bytes, so memory follows the longest text and the slice size, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
BLOCK = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits: words split at punctuation too.
IS_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_POW = np.cumprod(np.full(BLOCK + 1, _BASE, np.uint64), dtype=np.uint64)
_INV = np.cumprod(np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and xor-shift steps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch whose texts have about `limit` bytes, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if len(size) == 0:
        return
    part = np.maximum(np.cumsum(size) - 1, 0) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the offsets of each; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and text number of each word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = between[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:n]
    end = ~space
    end[:-1] &= space[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike in any place. To fold A-Z, pass LOWER[data]."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, "right"))
        if j == i:  # longer than a block: by length alone, so it is hashed this way everywhere
            out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
            i += 1
            continue
        at = starts[i]
        low = data[at : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * _POW[: len(low)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * _INV[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and their text numbers, in order of place.

    short: a text of 1 to k-1 words has one shingle, its whole sequence; else none.
    """
    m = len(h) - k + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = mix(acc + h[j : j + m])
        same = doc[:m] == doc[k - 1 :]
        sh, at = acc[same], doc[:m][same]
    else:
        sh, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    few = np.flatnonzero((count > 0) & (count < k)) if short else []
    if len(few):
        first = np.searchsorted(doc, few)
        extra = np.empty(len(few), np.uint64)
        for x, (f, c) in enumerate(zip(first, count[few])):
            acc = np.full(1, c, np.uint64)
            for j in range(c):
                acc = mix(acc * np.uint64(3) + h[f + j])
            extra[x] = acc[0]
        sh, at = np.concatenate([sh, extra]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        sh, at = sh[order], at[order]
    return sh, at
