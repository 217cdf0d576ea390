"""A bitmap of keys: which rows may have a key, told without dealing the rows out.

64 words of 64 bits in each of ROWS rows, 8 MB at any number of keys, so it can be
sent to every task. A row without one of the keys passes by chance as often as the
bitmap is full: one in 25 at 2.7 million keys, nearly always at billions; then the
join that follows does all the work, and the result is the same. A null key is
never none of the keys' by itself: it is a key like others. Empty tables, of rows
or of keys, give empty bitmaps or tables; the rows may have columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.storage import fresh

ROWS = 1 << 14


def _place(key: Column) -> tuple[Column, Column, Column]:
    at = F.pmod(F.coalesce(key, F.lit(0).cast("long")), F.lit(ROWS * 4096))
    return F.shiftright(at, 12).cast("int"), F.shiftright(at, 6).bitwiseAND(F.lit(63)).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(keys: DataFrame) -> DataFrame:
    """keys (key) to (row, words): the words, 64 of them, of each row with a bit set."""
    row, word, bit = _place(F.col("key"))
    one = keys.select(row.alias("row"), word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    bits = one.groupBy("row", "word").agg(F.bit_or("b").alias("bits"))
    # 64 entries at most
    packed = bits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return packed.select("row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def maybe(rows: DataFrame, key: Column, keys: DataFrame, of: Column, wanted: bool = True) -> DataFrame:
    """The rows whose key may be one of keys' (wanted), or surely is none."""
    at, words, own = (fresh(rows, f"sieve_{n}") for n in ("at", "words", "own"))
    row, word, bit = _place(key)
    placed = rows.select("*", F.struct(row.alias("row"), word.alias("word"), bit.alias("bit")).alias(own))
    packed = _bitmap(keys.select(of.alias("key"))).toDF(at, words)
    out = placed.join(F.broadcast(packed), F.col(f"{own}.row") == F.col(at), "left")
    found = F.coalesce(F.getbit(F.element_at(words, F.col(f"{own}.word") + 1), F.col(f"{own}.bit")) == 1, F.lit(False))
    return out.where(found == F.lit(wanted)).select(*[F.col(f"`{c}`") for c in rows.columns])
