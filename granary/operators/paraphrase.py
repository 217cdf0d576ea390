"""Rewriting with a cache and a safety check; without a client every text passes through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import prompts, text
from granary.functions.similarity import passes_safety
from granary.operators import calls

Client = Callable[[str], str | None]


def paraphrase(docs: DataFrame, cache: DataFrame, style: str, max_new_tokens: int = 256, client: Callable[[], Client] | None = None, column: str = "text", least: float = 0.75, names: bool = False, window: int = calls.WINDOW) -> DataFrame:
    """docs with cache_key, paraphrased and origin (cache, model or source).

    cache: (cache_key, output_text). The client is built once in each worker and is
    asked for the distinct texts the cache lacks, `window` at once in each task. An answer
    that drops a number, or shares too little with its source, or (names) has a new name, gives
    way to the source.
    """
    keyed = docs.withColumn("cache_key", text.cache_key(F.col(column), F.lit(style), max_new_tokens))
    # an upserted cache has one row a key; of several, the least text, so that every run takes the same
    known = cache.groupBy("cache_key").agg(F.min("output_text").alias("_cached"))
    rows = keyed.join(known, "cache_key", "left")
    if client is None:
        return rows.select(*docs.columns, "cache_key", F.coalesce("_cached", column).alias("paraphrased"), F.when(F.col("_cached").isNotNull(), F.lit("cache")).otherwise(F.lit("source")).alias("origin"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for part in batches:
            yield pd.DataFrame({"cache_key": part["cache_key"], "_source": part["source"], "_answer": list(calls.ordered(model, part["prompt"], window))})

    misses = rows.where("_cached is null").select("cache_key", F.col(column).alias("source")).dropDuplicates(["cache_key"])
    asked = misses.select("cache_key", "source", prompts.rewrite_prompt(F.lit(style), F.col("source")).alias("prompt")).mapInPandas(ask, "cache_key string, _source string, _answer string")
    safe = F.col("_answer").isNotNull() & F.coalesce(passes_safety(F.col("_source"), F.coalesce("_answer", F.lit("")), least, names), F.lit(False))
    answers = asked.select("cache_key", F.when(safe, F.col("_answer")).alias("_answer"))
    out = rows.join(answers, "cache_key", "left")
    origin = F.when(F.col("_cached").isNotNull(), F.lit("cache")).when(F.col("_answer").isNotNull(), F.lit("model")).otherwise(F.lit("source"))
    return out.select(*docs.columns, "cache_key", F.coalesce("_cached", "_answer", column).alias("paraphrased"), origin.alias("origin"))


def cache_rows(done: DataFrame, compat: bool = False) -> DataFrame:
    """New rows for the cache: rewrites only; compat: texts that passed through too."""
    rows = done.where("origin <> 'cache'" if compat else "origin = 'model'").dropDuplicates(["cache_key"])
    return rows.select("cache_key", F.lit("").alias("input_hash"), F.lit("").alias("style_hash"), F.lit("").alias("params_hash"), F.col("paraphrased").alias("output_text"))


def completion_text(body: str) -> str | None:
    """The text in a completion server's JSON answer."""
    import json

    try:
        got = json.loads(body)
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    first = (got.get("choices") or [{}])[0]
    found = [got.get("content")] + ([first.get("text") or first.get("content")] if isinstance(first, dict) else [])
    return next((x.strip() for x in found if isinstance(x, str)), None)


def http_client(url: str, max_new_tokens: int = 256, timeout: int = 20) -> Callable[[], Client]:
    """A client of a completion server; any failure is None."""

    def build() -> Client:
        import json
        import urllib.request

        def ask(prompt: str) -> str | None:
            body = json.dumps({"prompt": prompt, "n_predict": max_new_tokens, "temperature": 0.2, "stop": ["</s>"]}).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    return completion_text(r.read().decode("utf-8", "replace"))
            except OSError:
                return None

        return ask

    return build


def first_answer(*clients: Callable[[], Client]) -> Callable[[], Client]:
    """A client that asks one after the other until one answers; None if none does, so the text passes through."""

    def build() -> Client:
        made = [c() for c in clients]
        return lambda prompt: next((x for x in (m(prompt) for m in made) if x), None)

    return build


def counters() -> list[Column]:
    """inputs, rewritten, cache_hits, passed_through of rows with an origin."""
    of = lambda o: F.count_if(F.col("origin") == o)
    return [F.count("*").alias("inputs"), of("model").alias("rewritten"), of("cache").alias("cache_hits"), of("source").alias("passed_through")]


def stats(done: DataFrame) -> DataFrame:
    """One row of the counters."""
    return done.agg(*counters())


def command_client(command: list[str], timeout: int = 60) -> Callable[[], Client]:
    """A client that runs a command with the prompt as its last argument."""

    def build() -> Client:
        import subprocess

        def ask(prompt: str) -> str | None:
            try:
                return subprocess.run([*command, prompt], capture_output=True, text=True, timeout=timeout, check=False).stdout.strip() or None
            except (OSError, subprocess.SubprocessError):
                return None

        return ask

    return build
