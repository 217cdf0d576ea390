"""Keeping the catalog up to date: documents, chunks and the index of chunks, by what changed alone.

A scan is compared with the stored content hashes. New and changed documents are split
into chunks and put in the place of their earlier rows, those of documents that are gone
are dropped, and the index gets one segment. Each table finishes what broke off before; the
documents, whose hashes decide what is done, are written last, so a run that broke off is done
again as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import catalog, changes, keyed, matter, postings, sections
from granary.storage import Scratch


def _open(spark: SparkSession, base: str, name: str, buckets: int) -> keyed.KeyedTable:
    """The keyed table below base; an empty one if there is none yet. Chunks are kept by document: all of a document's go together."""
    fs, path = keyed.KeyedTable._fs(spark, f"{base}/{name}/head/_SUCCESS")
    if fs.exists(path):
        return keyed.KeyedTable(spark, f"{base}/{name}")
    empty = spark.createDataFrame([], T._parse_datatype_string(catalog.TABLES[name]))
    return keyed.KeyedTable.create(empty, f"{base}/{name}", "doc_id", buckets)


def update(scan: DataFrame, base: str, least: int = 40, most: int = 200, buckets: int = 64) -> dict[str, int]:
    """Bring the tables below base up to the documents of scan (doc_path, text), all that there are now; counts by state."""
    spark = scan.sparkSession
    scratch = Scratch(spark, "catalogue")
    documents, chunks = _open(spark, base, "documents", buckets), _open(spark, base, "chunks", buckets)
    now = scratch.save(matter.document_rows(scan), "now")
    found = scratch.save(changes.diff(documents.rows().select("doc_id", "content_hash"), now.select("doc_id", "content_hash")), "changes")
    counts = {"new": 0, "changed": 0, "gone": 0, "same": 0} | {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}
    if counts["new"] + counts["changed"] + counts["gone"]:
        fresh, gone = changes.split(found, now)
        made = scratch.save(sections.chunks(fresh, least, most, "doc_id", "body"), "chunks")
        touched = fresh.select("doc_id").unionByName(gone)
        catalog.check_foreign_key(made, fresh, "doc_id", "doc_id")
        old = scratch.save(chunks.rows().join(touched, "doc_id", "left_semi").select("chunk_id"), "old")
        fs, path = keyed.KeyedTable._fs(spark, f"{base}/index/segments")
        if fs.exists(path):
            # ids that stay are changed chunks; the others of these documents are gone
            postings.Store(spark, f"{base}/index").apply(made, old.join(made, "chunk_id", "left_anti"))
        else:
            postings.Store.create(made, f"{base}/index", "chunk_id", ["norm_text"], stem=True)
        chunks.upsert(made, touched)
        documents.upsert(fresh.select(*documents.schema.names), gone)
    return counts
