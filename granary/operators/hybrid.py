"""Fusion of lexical and vector hits, and resolution of ids to documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.similarity import min_max, rank_score


def lexical_score(compat: bool = False) -> Column:
    """From `bm25`: its negative, or 1 / (1 + bm25) in compatibility mode."""
    return rank_score(F.col("bm25")) if compat else -F.col("bm25")


def merge_and_rank(lexical: DataFrame, vector: DataFrame, alpha: float = 0.5, top_k: int = 6, prefix_ids: bool = False) -> DataFrame:
    """(qid, id, score, rank) of two lists (qid, id, score, rank).

    Each list is scaled to 0..1 by query. An id in both gets alpha * lexical +
    (1 - alpha) * vector, an id in one keeps its score. Ties: lexical hits in their
    order, then vector hits in theirs. prefix_ids: lex- and vec- before the ids, so
    that none is in both, as in compatibility mode.
    """

    def scaled(hits: DataFrame, side: str) -> DataFrame:
        id_ = F.concat(F.lit(f"{side}-"), F.col("id").cast("string")) if prefix_ids else F.col("id")
        return hits.select(F.col("qid").alias(f"q{side}"), id_.alias(f"i{side}"), min_max(F.col("score"), ["qid"]).alias(f"s{side}"), F.col("rank").alias(f"r{side}"))

    both = scaled(lexical, "lex").join(scaled(vector, "vec"), (F.col("qlex") == F.col("qvec")) & (F.col("ilex") == F.col("ivec")), "full_outer")
    blended = alpha * F.col("slex") + (1 - alpha) * F.col("svec")
    rows = both.select(
        F.coalesce("qlex", "qvec").alias("qid"),
        F.coalesce("ilex", "ivec").alias("id"),
        F.coalesce(blended, F.col("slex"), F.col("svec")).alias("score"),
        F.col("rlex").isNull().alias("late"),
        F.coalesce("rlex", "rvec").alias("place"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "late", "place", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("qid", "id", "score", "rank")


def diverse(hits: DataFrame, doc: str, per_doc: int = 1) -> DataFrame:
    """At most per_doc hits of one document for each query, the best first; ranks set anew."""
    own = Window.partitionBy("qid", doc).orderBy("rank")
    kept = hits.withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= per_doc).drop("_own")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def resolve(hits: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """hits with text and source; a hit without a document says so and has source `faiss`."""
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    out = hits.join(found, F.col("id") == F.col("_key"), "left")
    missing = F.concat(F.lit("[Missing mapping for "), F.col("id").cast("string"), F.lit("]"))
    return out.select(*hits.columns, F.coalesce("_text", missing).alias("text"), F.coalesce("_source", F.lit("faiss")).alias("source"))


def by_ordinal(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """hits (ordinal) with the id at that place of a sidecar (ordinal, id); none: the ordinal itself."""
    out = hits.join(ids.select(F.col("ordinal").alias("_at"), F.col("id").alias("_id")), F.col("ordinal") == F.col("_at"), "left")
    return out.select(*hits.columns, F.coalesce(F.col("_id").cast("string"), F.col("ordinal").cast("string")).alias("id"))


def snippets(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits (id) with the line of that id, or a note that there is none."""
    out = hits.join(lines.select(F.col("line_id").alias("_id"), F.col("line").alias("_line")), F.col("id") == F.col("_id"), "left")
    return out.select(*hits.columns, F.coalesce("_line", F.lit("(text not found)")).alias("snippet"))


def rerank(hits: DataFrame, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], top_k: int = 6) -> DataFrame:
    """hits (qid, id, query, text, ...) in the order of a model's scores of (query, text); the model is built once in each worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in batches:
            yield part.assign(model_score=[float(x) for x in model(list(zip(part["query"], part["text"])))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    scored = hits.mapInPandas(run, f"{kinds}, model_score double")
    order = Window.partitionBy("qid").orderBy(F.desc("model_score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
