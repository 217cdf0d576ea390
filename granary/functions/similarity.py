"""Similarities, norms and scores as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from granary.functions import text


def jaccard(inter: Column, left: Column, right: Column) -> Column:
    """From counts: two empty sets are equal, one empty set is unlike any other."""
    union = left + right - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column, eps: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(eps))


def l2_normalize(v: Column) -> Column:
    norm = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / norm)


def min_max(score: Column, by: list[str | Column]) -> Column:
    """Scaled to 0..1 within each group; a group of one score is all 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def rank_score(bm25: Column) -> Column:
    """1 / (1 + rank) as in compatibility mode; null where it would divide by zero."""
    return F.when(bm25 != -1.0, 1.0 / (1.0 + bm25))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, by a row of bit sets: one integer holds a row of the table."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def rouge_l(a: Column, b: Column) -> Column:
    """Common subsequence over the longer side; 0 if a side has no token."""
    x, y = text.rouge_tokens(a), text.rouge_tokens(b)
    longer = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(lcs(x, y) / longer)


def passes_safety(source: Column, out: Column, least: float = 0.75, names: bool = False) -> Column:
    """Numbers are kept and enough words are shared; names: no name is new either."""
    safe = text.numbers_preserved(source, out) & (rouge_l(source, out) >= least)
    return safe & (F.size(text.new_names(source, out)) == 0) if names else safe
