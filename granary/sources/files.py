"""Files as tables, and tables as files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.sources.extract import IMAGES, READERS, extractor, from_image


def same_files(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path) with what a local file is besides its name: device and inode, and whether it is reached by a link."""
    for batch in paths:
        known, link = [], []
        for path in batch.column(0).to_pylist():
            local = unquote(re.sub("^file:(//)?", "", path))
            try:
                own = os.stat(local)
                known.append(f"{own.st_dev}:{own.st_ino}")
                link.append(os.path.islink(local))
            except OSError:  # not a local file: its name is all that tells it
                known.append(path)
                link.append(False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.string()), pa.array(link, pa.bool_())], names=["path", "file", "link"])


def once(files: DataFrame) -> DataFrame:
    """Each file of files (path, ...) once: of names for one file the first that is no symbolic link, else the first."""
    told = files.select("path").distinct().mapInArrow(same_files, "path string, file string, link boolean")
    first = told.groupBy("file").agg(F.min(F.struct("link", "path")).alias("f")).select(F.col("f.path").alias("path"))
    return files.dropDuplicates(["path"]).join(first, "path", "left_semi")


def scan(spark: SparkSession, roots: list[str], pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below the roots, each file once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return once(reader.load(roots))


def collect(spark: SparkSession, roots: list[str], allowed: list[str] | None = None, max_mb: float = 32.0, ocr_images: bool = False, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(doc_path, ext, length, text, status) of each file. status: ok, failed, skipped_ext or skipped_size.

    Name and size decide before any content is read: files that are skipped have no text.
    """
    readers = {**READERS, **({s: from_image for s in IMAGES} if ocr_images else {}), **(readers or {})}
    kinds = sorted(readers if allowed is None else {a.lower() for a in allowed} & set(readers))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    listed = once(files.select("path", "length")).withColumn("ext", T.suffix(F.col("path")))
    plain = [r.replace("file://", "") for r in roots]
    below = T.relative_to(F.regexp_replace("path", "^file:(//)?", ""), plain)
    listed = listed.withColumn("doc_path", below).withColumn("skip", F.when(~F.col("ext").isin(kinds), F.lit("skipped_ext")).when(F.col("length") > max_mb * 1048576, F.lit("skipped_size")))
    wanted = files.where((F.col("length") <= int(max_mb * 1048576)) & T.suffix(F.col("path")).isin(kinds)).dropDuplicates(["path"])
    read = wanted.select(F.col("path").alias("_path"), extractor(readers)(T.suffix(F.col("path")), F.col("content")).alias("got"))
    out = listed.join(read, F.col("path") == F.col("_path"), "left")
    return out.select("doc_path", "ext", "length", F.coalesce("got.text", F.lit("")).alias("text"), F.coalesce("skip", "got.status", F.lit("failed")).alias("status"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(doc_path, text) of the .txt files below a folder, or of one file; bad bytes become U+FFFD."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return rows.select(T.relative_to(path, [root.replace("file://", "")]).alias("doc_path"), F.col("value").alias("text"))


def counters() -> list[Column]:
    """processed, written, skipped_size, skipped_ext, failed, ocr_used of rows (status, ext)."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    ocr = F.count_if((F.col("status") == "ok") & F.col("ext").isin(*IMAGES))
    return [is_("ok", "failed").alias("processed"), is_("ok").alias("written"), is_("skipped_size").alias("skipped_size"), is_("skipped_ext").alias("skipped_ext"), is_("failed").alias("failed"), ocr.alias("ocr_used")]


def stats(files: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row, or one for each group, of the counters."""
    return files.groupBy(*by).agg(*counters())


def write_log(spark: SparkSession, stats: dict, path: str) -> None:
    """One JSON line of a run: ts, stats, cwd."""
    row = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.struct(*[F.lit(v).alias(k) for k, v in stats.items()]).alias("stats"), F.lit(os.getcwd()).alias("cwd"))
    row.coalesce(1).write.mode("append").json(path)
