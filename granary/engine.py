"""The service surface: ingest, retrieve, chat, bots, health. Batches of requests, as tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import generate, hybrid, postings, vectors
from granary.plans import ingest
from granary.sources import config


class Engine:
    """One knowledge base below `base`: the tables that ingest writes.

    embedder: a factory of a function from texts to vectors, one for lines and
    queries; without it both are hashed word counts.
    """

    def __init__(self, spark: SparkSession, base: str, bots: str | None = None, embedder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, personas: DataFrame | None = None):
        self.spark, self.base, self.bots_dir, self.embedder, self.personas = spark, base, bots, embedder, personas

    def ingest(self, roots: list[str], **options) -> dict:
        return ingest.run(self.spark, roots, self.base, embedder=self.embedder, **options)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        if self.embedder:
            return vectors.embed(queries, self.embedder, text="query")
        return vectors.normalized(queries.withColumn("embedding", vectors.hashed_counts(F.col("query"))))

    def retrieve(self, queries: DataFrame, top_k: int = 6, alpha: float = 0.5, compat: bool = False) -> DataFrame:
        """(qid, id, text, score, source, rank) of queries (qid, query): both channels, 3 * top_k hits each, fused."""
        lex = postings.Store(self.spark, f"{self.base}/index").search(queries, 3 * top_k).select("qid", "id", hybrid.lexical_score(compat).alias("score"), "rank")
        lines, asked = self._table("vectors"), self._query_vectors(queries)
        vectors.check_dimensions(lines, asked)
        # a chunk is as near as its nearest line, and takes one place however many of its lines are near
        near = vectors.knn(lines, asked, 3 * top_k, id_="chunk_path")
        hits = hybrid.merge_and_rank(lex, near, alpha, top_k, prefix_ids=compat)
        chunks = self._table("deduped")
        bare = hits.withColumn("shown", F.col("id")).withColumn("id", F.regexp_replace("id", "^(lex|vec)-", "")) if compat else hits.withColumn("shown", F.col("id"))
        out = hybrid.resolve(bare, chunks, key="chunk_path", source="doc_path")
        return out.select("qid", F.col("shown").alias("id"), "text", "score", "source", "rank")

    def chat(self, requests: DataFrame, top_k: int = 6, alpha: float = 0.5, client: Callable | None = None) -> DataFrame:
        """(qid, text, citations, meta) of requests (qid, message, history, persona, temperature, max_tokens)."""
        hits = self.retrieve(requests.select("qid", F.col("message").alias("query")), top_k, alpha)
        asked = generate.messages(requests, generate.contexts(hits), self.personas)
        client = client or generate.pick_client(dict(os.environ))
        return generate.answers(asked, client) if client else generate.echo_answers(asked)

    def bots(self) -> list[dict]:
        return config.list_bots(self.bots_dir) if self.bots_dir else []

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}
