"""Mixed corpora and mirrored text files as a Spark data source.

    spark.dataSource.register(Corpus)
    spark.read.format("granary_corpus").option("paths", "/shared/a;/shared/b").load()
    docs.write.format("granary_corpus").mode("append").save("/shared/out")

Reading: the folders are listed once, each file once (by device and inode; a real name before
links, which `follow_links` lets in), in order of path. Partitions are planned by bytes,
so a few large files don't share a task. Filters on name, suffix and size decide before a file
is opened. Writing: each task writes below a folder of its own, and only the commit of the whole job moves
files to their places; an aborted one leaves nothing behind.

The folders have to be mounted on driver and executors alike. For stores that only Spark
reads, `files.collect` gives the same rows.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from granary.sources.extract import IMAGES, READERS, from_image

SCHEMA = "doc_path string, ext string, length long, text string, status string"
#: Bytes of the files of a partition.
PART_BYTES = 64 << 20
#: How filters compare; each is settled from a file's name and size.
_TESTS: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


@dataclass(frozen=True)
class Found:
    """A file: where it is, its name below its root, suffix and bytes."""

    path: str
    doc_path: str
    ext: str
    length: int


@dataclass
class Part(InputPartition):
    files: tuple[Found, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[tuple[str, str], ...]


def listed(roots: list[str], follow_links: bool = False) -> list[Found]:
    """Every file below the roots once, in order of path."""
    seen: dict[tuple[int, int], tuple[bool, str, Found]] = {}
    for root in roots:
        for folder, _, names in os.walk(root, followlinks=follow_links):
            for name in names:
                path = os.path.join(folder, name)
                link = os.path.islink(path)
                if link and not follow_links:
                    continue
                try:
                    own = os.stat(path)
                except OSError:
                    continue
                suffix = re.search(r"[^/.][^/]*(\.[^/.]+)$", name)
                found = Found(path, os.path.relpath(path, root), suffix[1].lower() if suffix else "", own.st_size)
                key = (own.st_dev, own.st_ino)
                if key not in seen or (link, path) < seen[key][:2]:
                    seen[key] = (link, path, found)
    return sorted((f for *_, f in seen.values()), key=lambda f: f.path)


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granary_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), schema.names, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        found = options.get("paths") or options.get("path")
        if not found:
            raise ValueError("option paths (folders, parted by ;) is missing")
        self.roots = [p for p in found.split(";") if p]
        self.max_bytes = float(options.get("max_mb", 32)) * 1048576
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.follow = options.get("follow_links", "false").lower() == "true"
        self.images = options.get("ocr_images", "false").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on doc_path, ext and length are settled here; Spark does the others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in {("doc_path",), ("ext",), ("length",)}:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        parts: list[list[Found]] = []
        size = 0
        for f in listed(self.roots, self.follow):
            if not all(_TESTS[type(t)](getattr(f, t.attribute[0]), t.value) for t in self.tests):
                continue
            if not parts or size + f.length > self.part_bytes:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += f.length
        return [Part(tuple(p)) for p in parts] or [Part(())]

    def read(self, partition: Part) -> Iterator[tuple]:
        readers = {**READERS, **({s: from_image for s in IMAGES} if self.images else {})}
        for f in partition.files:
            status, text = "ok", ""
            if f.ext not in readers:
                status = "skipped_ext"
            elif f.length > self.max_bytes:
                status = "skipped_size"
            else:
                try:
                    text = readers[f.ext](Path(f.path).read_bytes())
                except Exception:
                    status = "failed"
            yield f.doc_path, f.ext, f.length, text, status


class Writer(DataSourceWriter):
    """Texts to files: rows (doc_path, text); each becomes a .txt file below the folder, by its path."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        if not {"doc_path", "text"} <= set(columns):
            raise ValueError(f"needs columns doc_path and text, not {columns}")
        self.root, self.overwrite = options["path"], overwrite
        self.at, self.body = columns.index("doc_path"), columns.index("text")
        self.pending = os.path.join(self.root, f".pending-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        own, names = os.path.join(self.pending, uuid.uuid4().hex), []
        os.makedirs(own, exist_ok=True)
        for i, row in enumerate(rows):
            name = row[self.at] if row[self.at].endswith(".txt") else f"{row[self.at]}.txt"
            if not (Path(self.root) / name).resolve().is_relative_to(Path(self.root).resolve()):
                raise ValueError(f"{name} is not below {self.root}")
            held = os.path.join(own, str(i))
            Path(held).write_text(row[self.body] or "", encoding="utf-8")
            names.append((held, name))
        return Written(tuple(names))

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for entry in os.scandir(self.root):
                if not entry.name.startswith(".pending-"):
                    shutil.rmtree(entry.path) if entry.is_dir(follow_symlinks=False) else os.unlink(entry.path)
        for message in messages:
            for held, name in message.names if message else ():
                to = Path(self.root) / name
                to.parent.mkdir(parents=True, exist_ok=True)
                os.replace(held, to)
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)
