"""Prompt assembly over tables of requests, and model clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import prompts
from granary.operators import calls

MESSAGE = "array<struct<role:string,content:string>>"


def or_default(c: Column, default: float, falsy: bool = True) -> Column:
    """default for null and, if falsy, for zero."""
    return F.when(c.isNull() | (falsy & (c == 0)) if falsy else c.isNull(), F.lit(default)).otherwise(c)


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, snippets, citations) of hits (qid, id, score, source, text, rank): arrays in order of rank. A query has top_k hits."""
    row = F.struct("rank", prompts.snippet(F.col("id").cast("string"), F.col("score"), F.col("source"), F.col("text")).alias("snippet"), F.col("id").cast("string").alias("id"))
    packed = F.array_sort(F.collect_list(row))
    return hits.groupBy("qid").agg(packed.alias("p")).select("qid", F.transform("p", lambda x: x["snippet"]).alias("snippets"), F.transform("p", lambda x: x["id"]).alias("citations"))


def messages(requests: DataFrame, context: DataFrame, personas: DataFrame | None = None, system: str = "") -> DataFrame:
    """(qid, messages, citations, temperature, max_tokens) of requests (qid, message, history, persona, temperature, max_tokens).

    personas: (key, name, style, directives); a request that names another one is an error when its row is read.
    """
    rows = requests.join(context, "qid", "left")
    base = F.lit(system.strip())
    if personas is not None:
        known = personas.select(F.col("key").alias("_key"), prompts.system_prompt(F.col("name"), F.col("style"), F.col("directives")).alias("_prompt"))
        rows = rows.join(known, F.col("persona") == F.col("_key"), "left")
        unknown = F.raise_error(F.concat(F.lit("no persona "), F.col("persona")))
        base = F.when(F.col("persona").isNull(), base).when(F.col("_prompt").isNull(), unknown).otherwise(F.col("_prompt"))
    user = prompts.user_message(F.col("message"), F.coalesce("snippets", F.array().cast("array<string>")))
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content"))).cast(MESSAGE)
    history = F.coalesce(F.col("history").cast(MESSAGE), F.array().cast(MESSAGE))
    return rows.select("qid", F.concat(turn("system", base), history, turn("user", user)).alias("messages"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), or_default(F.col("temperature"), 0.3).alias("temperature"), or_default(F.col("max_tokens"), 1000).alias("max_tokens"))


def history_table(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, history): the turns of each conversation in order, as (role, content)."""
    packed = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def echo_answers(asked: DataFrame) -> DataFrame:
    return asked.select("qid", prompts.echo(F.col("messages")).alias("text"), "citations", F.create_map(F.lit("engine"), F.lit("echo")).alias("meta"))


def answers(asked: DataFrame, client: Callable[[], Callable[[list[dict], dict], tuple[str, dict]]], window: int = calls.WINDOW, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """The model's answer to each row. The client is built once in each worker; it takes messages and parameters.

    A task has `window` requests under way. One that fails `tries` times gives a row with a null text and the
    failure in meta, so the others' answers aren't lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = calls.retried(client(), tries, wait, (Exception,))

        def one(r) -> tuple[str | None, dict]:
            try:
                return model([{"role": m["role"], "content": m["content"]} for m in r.messages], {"temperature": r.temperature, "max_tokens": r.max_tokens})
            except Exception as e:
                return None, {"error": f"{type(e).__name__}: {e}"}

        for part in batches:
            got = list(calls.ordered(one, part.itertuples(), window))
            yield pd.DataFrame({"qid": part["qid"], "text": [g[0] for g in got], "citations": part["citations"], "meta": [{str(k): str(v) for k, v in g[1].items()} for g in got]})

    return asked.mapInPandas(run, f"qid {dict(asked.dtypes)['qid']}, text string, citations array<string>, meta map<string,string>")


def flat_prompt(turns: list[dict]) -> str:
    return "\n".join(f"{m['role'].upper()}:\n{m['content'].strip()}\n" for m in turns)


def generate_api_client(host: str, model: str, timeout: int = 180) -> Callable[[], Callable]:
    """A client of an HTTP server with a /api/generate endpoint."""

    def build() -> Callable:
        import json
        import urllib.request

        def ask(turns: list[dict], params: dict) -> tuple[str, dict]:
            body = {"model": model, "prompt": flat_prompt(turns), "stream": False, "options": {"temperature": float(params["temperature"] or 0.3), "num_predict": int(params["max_tokens"] or 1000)}}
            request = urllib.request.Request(f"{host}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r).get("response", "").strip(), {"engine": "generate-api", "model": model}

        return ask

    return build


def chat_api_client(url: str, model: str, key: str, timeout: int = 180) -> Callable[[], Callable]:
    """A client of an HTTP server with a chat-completions endpoint."""

    def build() -> Callable:
        import json
        import urllib.request

        def ask(turns: list[dict], params: dict) -> tuple[str, dict]:
            body = {"model": model, "messages": turns, "temperature": params["temperature"], "max_tokens": int(params["max_tokens"])}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"], {"engine": "chat-api", "model": model}

        return ask

    return build


def pick_client(env: dict[str, str]) -> Callable[[], Callable] | None:
    """The first of the generate server, the chat server, and (None) the echo, that the environment names."""
    if env.get("GENERATE_HOST"):
        return generate_api_client(env["GENERATE_HOST"], env.get("GENERATE_MODEL", "mistral:7b-instruct"))
    if env.get("CHAT_API_KEY"):
        return chat_api_client(env.get("CHAT_API_URL", "https://api.openai.com/v1/chat/completions"), env.get("CHAT_MODEL", "gpt-4o-mini"), env["CHAT_API_KEY"])
    return None
