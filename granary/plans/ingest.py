"""The ingest run: files to extracted documents, chunks, kept chunks, lines, vectors and postings.

Each stage's table is overwritten below `base`, so nothing of an earlier run stays;
a stage reads the best table that there is, as its predecessor wrote it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import catalog, chunking, dedup, paraphrase, postings, vectors
from granary.sources import files
from granary.sources.config import Ingest
from granary.storage import Scratch

STAGES = ("extracted", "normalized", "paraphrased", "deduped", "lines", "vectors")


def normalize(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """(doc_path, chunk_idx, chunk_path, text)."""
    clean = docs.select("doc_path", T.normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    rows = chunking.chunk(clean, size, overlap)
    return rows.select("doc_path", "chunk_idx", chunking.chunk_path(F.col("doc_path"), F.col("chunk_idx"), F.col("n_chunks")).alias("chunk_path"), F.col("chunk").alias("text"))


def kept(chunks: DataFrame, threshold: float = 0.90, k: int = 5, seen: Observation | None = None) -> DataFrame:
    """The chunks that no earlier kept chunk, in order of path and number, is like; their text as it was.

    seen: gets `inputs` and `kept` as the result is written.
    """
    order = F.struct("doc_path", "chunk_idx")
    verdict = dedup.deduplicate(chunks.withColumn("_order", order), threshold, k, key="_order")
    return _chosen(chunks, verdict, seen)


def _chosen(chunks: DataFrame, verdict: DataFrame, seen: Observation | None) -> DataFrame:
    if seen is not None:
        verdict = verdict.observe(seen, F.count("*").alias("inputs"), F.count_if("kept").alias("kept"))
    good = verdict.where("kept").select(F.col("id").alias("_id"))
    return chunks.join(good, F.struct("doc_path", "chunk_idx") == F.col("_id"), "left_semi")


def without_simhash_copies(chunks: DataFrame, radius: int = 3, k: int = 5, seen: Observation | None = None) -> DataFrame:
    """The pre-filter: chunks whose fingerprint no earlier kept chunk's is within the radius of; those without a shingle stay."""
    signs = dedup.signatures(chunks.withColumn("_order", F.struct("doc_path", "chunk_idx")), k, key="_order")
    return _chosen(chunks, dedup.simhash_dedup(signs, radius), seen)


def without_semantic_copies(chunks: DataFrame, embedder: Callable | None = None, same: float = 0.92, cross: float = 0.96, seen: Observation | None = None) -> DataFrame:
    """Chunks whose vector no earlier kept chunk's is as near as `same` in its document, `cross` in another."""
    rows = chunks.select(F.struct("doc_path", "chunk_idx").alias("vec_id"), "doc_path", "text")
    rows = vectors.embed(rows, embedder) if embedder else vectors.normalized(rows.withColumn("embedding", vectors.hashed_counts(F.col("text"))))
    rows = Scratch(chunks.sparkSession, "semantic").save(rows.drop("text"), "vectors")
    return _chosen(chunks, dedup.semantic_dedup(rows, same, cross, group="doc_path"), seen)


def embed_lines(chunks: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """(line_id, chunk_path, line_no, text, embedding) of each line that is not blank."""
    rows = chunking.lines(chunks, "chunk_path").select(chunking.line_id(F.col("chunk_path"), F.col("line_no")).alias("line_id"), "chunk_path", "line_no", F.col("line").alias("text"))
    return vectors.embed(rows, embedder) if embedder else vectors.normalized(rows.withColumn("embedding", vectors.hashed_counts(F.col("text"))))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none; any other failure is one."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def best(spark: SparkSession, base: str, before: str) -> DataFrame:
    """The latest table of the stages before one that is there and has rows."""
    for name in reversed(STAGES[: STAGES.index(before)]):
        found = _stored(spark, f"{base}/{name}")
        if found is not None and not found.isEmpty():
            return found
    raise FileNotFoundError(f"no table below {base} that stage {before} could read")


def mirror(docs: DataFrame, root: str, path: str = "doc_path", text: str = "text") -> DataFrame:
    """Write each text to a .txt file of its own below root, by its path; (path) of those written.

    For corpora that other programs read as files: root is a folder that all executors share.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = Path(root) / (name if name.endswith(".txt") else f"{name}.txt")
                if not at.resolve().is_relative_to(Path(root).resolve()):
                    raise ValueError(f"{name} is not below {root}")
                at.parent.mkdir(parents=True, exist_ok=True)
                whole = at.with_name(f".{at.name}.{uuid.uuid4().hex}")  # a task that runs twice leaves one whole file
                whole.write_text(body or "", encoding="utf-8")
                whole.replace(at)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return docs.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(put, "path string")


def save_snapshot(vectors_: DataFrame, base: str, id_: str = "line_id", vector: str = "embedding") -> None:
    """The vectors with the id of each (one table, so they can't fall apart), after a check of their lengths and ids."""
    found = vectors_.agg(F.count("*").alias("n"), F.count_distinct(id_).alias("ids"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if found["n"] != found["ids"] or found["a"] != found["b"]:
        raise ValueError(f"{found['n']} vectors of {found['a']} to {found['b']} numbers for {found['ids']} ids")
    vectors_.select(F.col(id_).alias("id"), F.col(vector).alias("embedding")).write.mode("overwrite").parquet(f"{base}/snapshot")


def run(spark: SparkSession, roots: list[str], base: str, config: Ingest = Ingest(), only: str | None = None, style: str = "", client: Callable | None = None, embedder: Callable | None = None) -> dict:  # noqa: B008
    """Run all stages, or one, and return its counts, which the writes themselves observe."""
    began, stats = time.time(), {}

    def put(name: str, df: DataFrame, metrics: list[Column] = []) -> dict:  # noqa: B006
        """Write a stage's table; the metrics of its rows, from the same job."""
        seen = Observation()
        (df.observe(seen, *metrics) if metrics else df).write.mode("overwrite").parquet(f"{base}/{name}")
        return dict(seen.get) if metrics else {}

    wanted = [s for s in STAGES if only in (None, s)]
    if "extracted" in wanted:
        stats |= put("extracted", files.collect(spark, roots, max_mb=config.max_mb, ocr_images=config.ocr_images), files.counters())
    if "normalized" in wanted:
        rows = normalize(best(spark, base, "normalized").where("status = 'ok'"), config.chunk_size, config.chunk_overlap)
        # each document has a first chunk
        stats |= put("normalized", rows, [F.count_if(F.col("chunk_idx") == 0).alias("docs"), F.count("*").alias("total_chunks")])
    if "paraphrased" in wanted and (config.enable_paraphrase or only == "paraphrased"):
        rows = best(spark, base, "paraphrased")
        cache = _stored(spark, f"{base}/paraphrase_cache")
        if cache is None:
            cache = spark.createDataFrame([], "cache_key string, output_text string")
        done = paraphrase.paraphrase(rows.withColumn("text", T.light_clean("text")), cache, style, client=client)
        stats |= put("paraphrased", done.withColumn("text", F.col("paraphrased")).drop("paraphrased"), paraphrase.counters())
        done = spark.read.parquet(f"{base}/paraphrased").withColumn("paraphrased", F.col("text"))
        new = paraphrase.cache_rows(done).select("cache_key", "output_text")
        # written beside the old one and read again, as a table can't be overwritten while it is read
        merged = Scratch(spark, "cache").save(catalog.upsert(cache.select("cache_key", "output_text"), new, "cache_key"), "merged")
        put("paraphrase_cache", merged)
    if "deduped" in wanted:
        rows = best(spark, base, "deduped").select("doc_path", "chunk_idx", "chunk_path", "text")
        scratch, looks = Scratch(spark, "deduped"), []
        steps: list[Callable[[DataFrame, Observation], DataFrame]] = [lambda x, seen: kept(x, config.dedup_threshold, config.shingle, seen)]
        if config.dedup_simhash:
            steps.insert(0, lambda x, seen: without_simhash_copies(x, k=config.shingle, seen=seen))
        if config.dedup_semantic:
            steps.append(lambda x, seen: without_semantic_copies(x, embedder, seen=seen))
        for i, step in enumerate(steps):
            looks.append(Observation())
            rows = step(rows, looks[-1])
            if i < len(steps) - 1:
                rows = scratch.save(rows, f"step-{i}")
        put("deduped", rows)
        lost = [x.get["inputs"] - x.get["kept"] for x in looks]
        stats |= {"inputs": looks[0].get["inputs"], "kept": looks[-1].get["kept"], "dropped": sum(lost), "dropped_simhash": lost[0] if config.dedup_simhash else 0, "dropped_semantic": lost[-1] if config.dedup_semantic else 0}
    if "lines" in wanted:
        put("lines", chunking.lines(best(spark, base, "lines"), "chunk_path"))
    if "vectors" in wanted:
        source = spark.read.parquet(f"{base}/deduped")
        put("vectors", embed_lines(source, embedder))
        postings.Store.create(source, f"{base}/index", "chunk_path", ["text"], stem=True)
    stats["elapsed_seconds"] = round(time.time() - began, 3)
    files.write_log(spark, stats, f"{base}/log")
    return stats
