"""Token counts by field or section, from one encoding of the whole document.

A document is encoded once, as one text, so tokens are those that training sees.
Sections tile the text: with several fields, each field and the separator after
it; else each line and its line feed. Token spans are joined to section spans by
interval: a token belongs to the section that holds it. A token that crosses a
boundary is allotted whole, to the section with most of its characters, and on a
tie to the earlier one, so the counts of a document's sections add up to its own.

A character counts for the token that has its first byte; a token without any
(the tail of a split character) belongs to the section of its first byte.

Edges: a null or empty document has one section, 0, without tokens; a null field
is an empty one; a section may have no token. Each row is a document of its own,
so repeated ids and rows are counted separately and may repeat (doc_id, section). A
very long text is encoded whole, as a shorter one is. An empty table gives an empty
table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import tokens


def bounds(text: bytes, fields: list[bytes] | None) -> np.ndarray:
    """First byte of each section."""
    if fields is None:
        data = np.frombuffer(text, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        return starts if len(starts) == 1 or starts[-1] < len(data) else starts[:-1]
    return np.concatenate([[0], np.cumsum([len(f) + 1 for f in fields[:-1]])]).astype(np.int64)


def attribute(text: bytes, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and characters of each section; ends: the end byte of each token."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    begin = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    across = np.flatnonzero(first != last)
    stop = np.append(starts[1:], len(text))
    for t in across:
        parts = range(first[t], last[t] + 1)
        owner[t] = max(parts, key=lambda i: (lead[min(ends[t], stop[i])] - lead[max(begin[t], starts[i])], -i))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n), lead[stop] - lead[starts]


def token_counts(docs: DataFrame, fields: list[str] = ["text"], path: str | None = None, doc_id: str = "doc_id") -> DataFrame:  # noqa: B006
    """(doc_id, section, n_tokens, n_crossing, n_chars). One field: sections are its lines; more: the fields, joined by line feeds."""
    path = path or tokens.default_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(f).alias(f"field{i}") for i, f in enumerate(fields)])
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = tokens.load(path)
        for batch in batches:
            held, made = [], 0

            def out() -> pa.RecordBatch:
                at = np.repeat([h[0] for h in held], [len(h[1]) for h in held]) if held else np.zeros(0, np.int64)
                cols = [np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(1, 5)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at.astype(np.int64))), pa.array(cols[0].astype(np.int32)), *[pa.array(c.astype(np.int64)) for c in cols[1:]]], names=["doc_id", "section", "n_tokens", "n_crossing", "n_chars"])

            for i in range(batch.num_rows):
                own = [(c[i].as_py() or "") for c in batch.columns[1:]]
                text = "\n".join(own)
                raw = text.encode()
                starts = bounds(raw, None if len(own) == 1 else [x.encode() for x in own])
                ids = tokens.encode(encoder, text)
                got = attribute(raw, np.cumsum(size[ids]), starts) if len(ids) else (np.zeros(len(starts)),) * 3
                held.append((i, np.arange(len(starts)), *got))
                made += len(starts)
                if made > 50_000:
                    yield out()
                    held, made = [], 0
            yield out()

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, section int, n_tokens long, n_crossing long, n_chars long")
