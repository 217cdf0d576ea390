"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each a few records, and a last,
skippable frame with a table of the frames' sizes and a footer: any Zstandard tool
reads a bundle from end to end, and a reader with the table seeks to one frame. The
index maps a record's identifier to its bundle, frame and offset inside the frame.

Bundles are rows of a table (bundle, content), so they live in whatever store Spark
writes; `content` is the archive file, byte for byte. They hold BUNDLE_BYTES of
records at most, or one record that is larger.

Of pages with equal payloads of at least `least` bytes, that with the largest page
id is a response; the others are revisits that name it.

Edges: a null payload is empty; a null url is about:blank; a null page id is the
smallest and is left out of its record's head; ids and urls are percent-encoded there, so
no line break of theirs ends a head. Rows that repeat page id and payload (ties) get equal
records: with the largest id, all of them are responses. A very long payload is a frame
and a bundle of its own. An empty table gives empty tables. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.storage import Scratch

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
PART_BYTES = 128 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_SPACE = uuid.UUID("6f1d0f0e-3f0b-5c1e-9d5a-2b8a3c4d5e6f")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: object, digest: str) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{page}/{digest}').urn}>"


def record(page: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its page and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([] if page is None else [("X-Page-Id", quote(str(page), safe=" "))]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", quote(str(refers_to), safe=" "))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    return head, data[begin:stop], stop + 4


def bundle(frames: list[bytes], level: int = LEVEL) -> bytes:
    """The archive file of some frames' contents."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    packed = [packer.compress(f) for f in frames]
    table = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames)) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(content: bytes) -> np.ndarray:
    """(first byte, bytes, bytes unpacked) of each frame, from the end of the archive."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_MAGIC or flags & 0x80:
        raise ValueError("no seek table")
    sizes = np.frombuffer(content[-9 - 8 * count : -9], "<u4").reshape(-1, 2).astype(np.int64)
    return np.column_stack([np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes])


def frame(content: bytes, i: int, table: np.ndarray | None = None) -> bytes:
    """The contents of frame i; table: the archive's seek table, if it is read already."""
    first, size, full = (int(x) for x in (seek_table(content) if table is None else table)[i])
    return zstandard.ZstdDecompressor().decompress(content[first : first + size], max_output_size=full)


def read_record(content: bytes, i: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record at an offset of frame i; no other frame is unpacked."""
    head, block, _ = parse(frame(content, i), offset)
    return head, block


def typed(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """pages (page_id, url, html) with `revisit` and, for revisits, `refers_to`."""
    ids = pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    ids = scratch.save(ids.where(F.col("size") >= least), "digests")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    # narrow rows meet here; the payloads are dealt out by page below, whatever their digests
    again = ids.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", "digest", "last").distinct().toDF("again_id", "again_digest", "refers_to")
    again = scratch.save(again, "again")
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return pages.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (digest == F.col("again_digest")), "left").select("page_id", "url", "html", F.col("again_digest").isNotNull().alias("revisit"), "refers_to")


def write(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(bundle, content) of the archives, and the index (record_id, bundle, frame, offset, length)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = typed(pages, scratch, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, open_, index, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            if open_:
                frames.append(b"".join(open_))
                open_.clear()
            content = bundle(frames)
            name = hashlib.sha1(content, usedforsecurity=False).hexdigest()
            own = [{"record_id": i, "frame": f, "offset": o, "length": n} for i, f, o, n in index]
            frames.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([own], _INDEX)], names=["bundle", "content", "index"])

        for batch in batches:
            columns = [batch.column(c) for c in range(5)]
            for i in range(batch.num_rows):
                page, where, text, revisit, refers = (c[i].as_py() for c in columns)
                payload = (text or "").encode()
                made = record(page, where, payload, refers, revisit)
                held = sum(map(len, open_))
                if open_ and held + len(made) > frame_bytes:
                    frames.append(b"".join(open_))
                    open_.clear()
                    held = 0
                if index and size + len(made) > bundle_bytes:
                    yield close()
                    size, held = 0, 0
                index.append((record_id(page, base32_sha1(payload)), len(frames), held, len(made)))
                open_.append(made)
                size += len(made)
        if index:
            yield close()

    made = scratch.save(rows.mapInArrow(run, "bundle string, content binary, index array<struct<record_id: string, frame: int, offset: long, length: long>>"), "bundles", compression="uncompressed")
    index = made.select("bundle", F.explode("index").alias("i")).select("i.record_id", "bundle", "i.frame", "i.offset", "i.length")
    return made.select("bundle", "content"), index


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def _row(head: dict[str, str], block: bytes) -> tuple:
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one that was written")
    page, refers = (None if head.get(k) is None else unquote(head[k]) for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
    return page, size, digest, kind, refers, head["WARC-Target-URI"], head["WARC-Record-ID"], payload if kind == "response" else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.string()] * 5, pa.binary()))], names=_READ)


def _typed(out: DataFrame, page_type: str) -> DataFrame:
    return out.select(F.col("page_id").cast(page_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_type), "url", "record_id", "payload")


def read(bundles: DataFrame, page_type: str = "long") -> DataFrame:
    """A row for each record of the archives, from their bytes alone. `payload` is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                table = seek_table(raw)
                for i in range(len(table)):
                    data, at, rows = frame(raw, i, table), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append(_row(head, block))
                    yield _batch(rows)

    return _typed(bundles.select("content").mapInArrow(run, _READ_SCHEMA), page_type)


def lookup(bundles: DataFrame, index: DataFrame, page_type: str = "long") -> DataFrame:
    """A row for each row of index (record_id, bundle, frame, offset): its record, read at its place.

    Of an archive only the frames that the index names are unpacked, each once. An
    archive's entries meet it in one row: they are as many as it has records.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    # archives meet their entries in portions of bounded bytes, however many there are
    parts = max(int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    wanted = index.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "record_id"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1)):
                raw = content.as_py()
                table, last, data, rows = seek_table(raw), None, b"", []
                for own in at.as_py():
                    if own["frame"] != last:
                        if rows:
                            yield _batch(rows)
                        last, data, rows = own["frame"], frame(raw, own["frame"], table), []
                    head, block, _ = parse(data, own["offset"])
                    if head["WARC-Record-ID"] != own["record_id"]:
                        raise ValueError(f"{own['record_id']} is not where the index says")
                    rows.append(_row(head, block))
                yield _batch(rows)

    # archives of equal bytes have one name: one of them is read for all their entries' repeats
    met = bundles.repartition(parts, "bundle").dropDuplicates(["bundle"]).join(wanted.repartition(parts, "bundle"), "bundle")
    return _typed(met.select("content", "at").mapInArrow(run, _READ_SCHEMA), page_type)


_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "payload"]
_READ_SCHEMA = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in _READ)
