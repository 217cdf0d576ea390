"""Embedding, normalisation and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from granary.functions import text as T
from granary.functions.similarity import l2_normalize
from granary.operators import calls, topk
from granary.storage import Scratch

BATCH = 64


@F.pandas_udf(ArrayType(FloatType()))
def _counted(slots: pd.Series, dim: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else np.bincount(np.asarray(s, np.int64), minlength=d).astype(np.float32) for s, d in zip(slots, dim)])


def hashed_counts(c: Column, dim: int = 384) -> Column:
    """A count vector over hashed words: the default embedder; needs no model. A null text is empty."""
    slots = F.transform(T.words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return _counted(slots, F.lit(dim))


def embed(docs: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", out: str = "embedding", batch: int = BATCH, normalize: bool = True) -> DataFrame:
    """docs with a vector column; `factory` builds the model once in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            texts, made = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                x = np.asarray(model(texts[i : i + batch]), np.float32)
                if normalize:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                made += list(x)
            yield pd.Series(made)

    return docs.withColumn(out, run(F.col(text)))


def http_embedder(host: str, model: str, timeout: int = 30, window: int = calls.WINDOW, tries: int = 3) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory for `embed` that asks a server's /api/embeddings, a text a request, `window` at once; the last of `tries` failures is an error."""

    def build() -> Callable[[list[str]], np.ndarray]:
        import json
        import urllib.request

        def one(text: str) -> list[float]:
            body = json.dumps({"model": model, "prompt": text}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{host}/api/embeddings", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                return json.load(r)["embedding"]

        again = calls.retried(one, tries)
        return lambda texts: np.array(list(calls.ordered(again, texts, window)), np.float32)

    return build


def local_embedder(name: str = "BAAI/bge-small-en-v1.5", device: str = "cpu", offline: bool = False) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory for `embed` with a sentence model, if its library is installed; loaded once in each worker."""

    def build() -> Callable[[list[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, device=device, local_files_only=offline)
        return lambda texts: np.asarray(model.encode(texts, batch_size=len(texts), convert_to_numpy=True, normalize_embeddings=False, show_progress_bar=False), np.float32)

    return build


def normalized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(vector, l2_normalize(F.col(vector)))


def check_dimensions(vectors: DataFrame, queries: DataFrame, vector: str = "embedding") -> None:
    """Raises unless all vectors of both tables have one length."""
    found = vectors.select(F.size(vector).alias("n")).unionByName(queries.select(F.size(vector).alias("n"))).agg(F.min("n"), F.max("n")).first()
    if found[0] != found[1]:
        raise ValueError(f"vectors of {found[0]} to {found[1]} dimensions")


#: Numbers in the vectors of one block of rows.
NUMBERS = 1 << 18


def _sorted_blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Blocks (None, ids ascending, vectors, first vector of each id) of a batch (id, v)."""
    ids = topk.keys(batch.column(0))
    if not len(ids):
        return
    flat = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    step = max(NUMBERS // max(flat.shape[1], 1), 1)
    for i in range(0, len(order), step):
        part = order[i : i + step]
        distinct, first = np.unique(ids[part], return_index=True)
        yield None, distinct, flat[part], first


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", qid: str = "qid", vector: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k ids of greatest inner product for each query; ties by id.

    An id with several vectors counts once, by its best. Groups of queries go to the rows,
    which stay where they are; each task keeps k ids a query while its rows go by. Rows and
    queries without a vector take no part.
    """
    kind, qkind = (dict(d.dtypes)[c] for d, c in ((vectors, id_), (queries, qid)))
    scratch = Scratch(vectors.sparkSession, "knn")
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(qid).alias("id"), F.col(vector).alias("v"))
    found = [topk.streamed(rows, group, k, _sorted_blocks, kind, qkind, unique=True) for group in topk.groups(asked, scratch)]
    return topk.merged([f.groupBy("qid", "id").agg(F.max("score").alias("score")) for f in found], k)
