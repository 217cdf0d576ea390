"""Front matter: the YAML block at a document's head as typed columns, and the catalog's rows from it."""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from granary.functions import text as T
from granary.operators import changes, chunking

_TEXT, _LIST = S.StringType(), S.ArrayType(S.StringType())
KIND = S.StructType([S.StructField(n, t) for n, t in (("title", _TEXT), ("tags", _LIST), ("tech", _LIST), ("dates", S.MapType(_TEXT, S.DateType())), ("summary", _TEXT), ("other", _TEXT), ("reason", _TEXT))])


def _typed(block: str | None) -> dict | None:
    """A block's fields; one that is no mapping, or has a field of another type, keeps what is sound and says what isn't."""
    import yaml

    if block is None:
        return None
    out = {"title": None, "tags": None, "tech": None, "dates": None, "summary": None, "other": None, "reason": None}
    try:
        found = yaml.safe_load(block)
    except (yaml.YAMLError, ValueError) as e:
        return out | {"reason": f"not YAML: {str(e).splitlines()[0]}"}
    if not isinstance(found, dict):
        return out | ({} if found is None else {"reason": "not a mapping"})
    bad = []
    found = {str(k): v for k, v in found.items()}
    for name in ("title", "summary"):
        v = found.pop(name, None)
        if isinstance(v, (dict, list)):
            bad.append(name)
        elif v is not None:
            out[name] = str(v)
    for name in ("tags", "tech"):
        v = found.pop(name, None)
        v = [v] if isinstance(v, str) else v
        if isinstance(v, list) and not any(isinstance(x, (dict, list)) for x in v):
            out[name] = [str(x) for x in v if x is not None]
        elif v is not None:
            bad.append(name)
    dates = found.pop("dates", None)
    if isinstance(dates, dict):
        out["dates"] = {}
        for k, v in dates.items():
            day = _day(v)
            if day is None:
                bad.append(f"dates.{k}")
            else:
                out["dates"][str(k)] = day
    elif dates is not None:
        bad.append("dates")
    if found:
        out["other"] = json.dumps(found, default=str, sort_keys=True, ensure_ascii=False)
    return out | ({"reason": "wrong type: " + ", ".join(bad)} if bad else {})


def _day(v: object) -> datetime.date | None:
    if isinstance(v, datetime.datetime):
        return v.date()
    if isinstance(v, datetime.date):
        return v
    try:
        return datetime.date.fromisoformat(v.strip()) if isinstance(v, str) else None
    except ValueError:
        return None


@F.pandas_udf(KIND)
def _fields(block: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("title", "tags", "tech", "dates", "summary", "other", "reason"))
    rows = [_typed(b) or empty for b in block]
    return pd.DataFrame(rows, columns=list(empty), dtype=object)


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `matter` (KIND; null without a block) and `body`. Only texts that have a block go through Python."""
    block, body = chunking.front_matter(F.col(text))
    rows = docs.withColumn("_block", block).withColumn("body", body)
    with_, without = rows.where("_block IS NOT NULL"), rows.where("_block IS NULL")
    return with_.withColumn("matter", _fields("_block")).drop("_block").unionByName(without.withColumn("matter", F.lit(None).cast(KIND)).drop("_block"))


def _json(c: Column) -> Column:
    return F.to_json(c)


def document_rows(docs: DataFrame, path: str = "doc_path", text: str = "text") -> DataFrame:
    """Rows of the catalog's `documents`, with the body below the block: (doc_id, title, tags_json, tech_json, dates_json, source_path, content_hash, body).

    doc_id is the path. Without a title in the block, the first heading is the title, else the file's name.
    """
    rows = parsed(docs.select(F.col(path).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    heading = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#{1,6}[ \t]+([^\n]*)", 1)), F.lit(""))
    title = F.coalesce(F.nullif(F.col("matter.title"), F.lit("")), heading, T.stem(F.col("doc_id")))
    return rows.select("doc_id", title.alias("title"), _json(F.col("matter.tags")).alias("tags_json"), _json(F.col("matter.tech")).alias("tech_json"), _json(F.col("matter.dates")).alias("dates_json"), F.col("doc_id").alias("source_path"), changes.content_hash(F.col("text")).alias("content_hash"), "body")
