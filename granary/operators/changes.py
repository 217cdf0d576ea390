"""What changed between a stored table of content hashes and a scan, so that only that is done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of a text; a null one (a file that could not be read) has a null hash."""
    return F.sha2(text, 256)


def diff(stored: DataFrame, scan: DataFrame, key: str = "doc_id", digest: str = "content_hash") -> DataFrame:
    """(key, state): new, changed, gone or same, of each key of either table; keys are distinct in each.

    One join on the key over two narrow columns. A hash that was null and is null is the same.
    """
    old = stored.select(F.col(key).alias("_old"), F.col(digest).alias("_was"), F.lit(True).alias("_had"))
    now = scan.select(F.col(key).alias("_new"), F.col(digest).alias("_is"), F.lit(True).alias("_has"))
    both = old.join(now, F.col("_old") == F.col("_new"), "full_outer")
    state = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "gone").when(F.col("_was").eqNullSafe(F.col("_is")), "same").otherwise("changed")
    return both.select(F.coalesce("_new", "_old").alias(key), state.alias("state"))


def split(changes: DataFrame, docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents to take in (new and changed), and the keys to drop."""
    fresh = changes.where(F.col("state").isin("new", "changed")).select(key)
    return docs.join(fresh, key, "left_semi"), changes.where(F.col("state") == "gone").select(key)
