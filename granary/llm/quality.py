"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source.

The sketch is a table of counts over log-linear buckets (the leading PRECISION bits
of an integer measure), so two sketches merge by adding counts, a hot group is
combined before the shuffle, and a quantile is off by a factor of 2**-(PRECISION-1)
at most. A measure's fence lies beyond a quantile of the group, its level, by `reach`
times the distance of that quantile from the median, so the group's own spread sets
it and no number is added: where nine of ten documents have no symbols, symbols are
unusual; where they are usual, the fence moves out. A level of 0.8 stays put until a
fifth of the group is junk. A document is let the noise of counting too: `reach` times
the root of the occurrences that the fence allows it and of the share of documents
beyond the level, so two or three in a text are within where nobody has any.
Fences of a group of n documents are drawn towards those of its language, and these
towards those of all, with the weight of WEIGHT documents: no size switches anything.

Edges: null text is empty, so it has no words and fails the base rule; null
language or source is a group of its own; repeated rows count as often as they
occur, and equal measures (ties) share a verdict; a very long text is one row of
counts like others; an empty table gives an empty table; extra columns, whatever
their names, are carried (keep_good) or ignored (quality).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import words
from granary.llm.storage import Scratch, fresh

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
PRECISION = 8
#: measure: (numerator, denominator, scale, both sides, level in thousandths, reach).
#: Repeats are rare and come in clumps, so most documents have none and only the far tail has a spread.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, False, 800, 6),
    "word_length": ("word_chars", "n_words", 100, True, 800, 6),
    "upper": ("n_upper", "word_chars", 1000, False, 800, 6),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False, 990, 2),
    "repeats": ("n_repeat_words", "n_words", 1000, False, 990, 2),
}
WEIGHT = 100

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))


def _line_repeats(raw: bytes) -> tuple[int, int]:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def _repeat_words(h: np.ndarray) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    if len(h) < 4:
        return 0
    w = words.mix(words.mix(h[:-2]) * np.uint64(3) + words.mix(h[1:-1] * np.uint64(5)) + h[2:])
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    cover = np.zeros(len(h), bool)
    for j in range(3):
        cover[at + j] = True
    return int(cover.sum())


def count(batch: pa.RecordBatch, column: int) -> dict[str, np.ndarray]:
    """The COUNTS of each text. Words keep their case here."""
    parts = []
    for part in words.slices(batch, column):
        data, offs = words.text_bytes(part.column(column))
        n = len(offs) - 1
        starts, ends, doc = words.spans(data, offs)
        total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offs])
        space, lead = words.IS_SPACE[data], (data & 0xC0) != 0x80
        h = words.hashes(data, starts, ends)
        cut = np.searchsorted(doc, np.arange(n + 1))
        out = {"n_words": np.diff(cut), "word_chars": total(lead & ~space), "n_symbols": total(_IS_SYMBOL[data]), "n_upper": total((data >= 65) & (data <= 90))}
        raw = data.tobytes()
        lines = [_line_repeats(raw[offs[i] : offs[i + 1]]) for i in range(n)]
        out["n_lines"], out["n_dup_lines"] = (np.array([x[k] for x in lines], np.int64) for k in (0, 1))
        out["n_repeat_words"] = np.array([_repeat_words(h[cut[i] : cut[i + 1]]) for i in range(n)], np.int64)
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in COUNTS}


def counted(docs: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """docs with a struct of the COUNTS of its text appended; rows and other columns are unchanged."""
    column = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(k, T.LongType()) for k in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count(batch, column)
            made = pa.StructArray.from_arrays([pa.array(got[k], pa.int64()) for k in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def base_failed(c: str) -> Column:
    words_, again = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return (words_ < 50) | (100 * again > 50 * words_)


def _bucket(x: Column) -> Column:
    """The leading PRECISION bits of a count and how many bits follow, as one ordered number."""
    drop = F.greatest(F.lit(0), F.length(F.bin(x)) - PRECISION)
    return (drop.cast("long") * (1 << PRECISION) + F.call_function("shiftright", x, drop)).cast("long")


def _value(bucket: Column, top: bool = False) -> Column:
    """The least, or the greatest, number of a bucket."""
    drop = F.floor(bucket / (1 << PRECISION)).cast("int")
    return F.call_function("shiftleft", F.pmod(bucket, F.lit(1 << PRECISION)) + int(top), drop) - int(top)


def measured(c: str) -> list[Column]:
    """The MEASURES as whole numbers, from counts c."""
    return [F.expr(f"({m[2]} * {c}.{m[0]}) div greatest({c}.{m[1]}, 1)").alias(name) for name, m in MEASURES.items()]


def sketch(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of a table of lang, source and the MEASURES."""
    long = measures.select("lang", "source", F.posexplode(F.array(*[_bucket(F.col(m)) for m in MEASURES])).alias("measure", "bucket"))
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, n, low, high): the group's own fences of each measure."""
    keys = [*by, "measure"]
    cells = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"seen": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys))})
    of = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in MEASURES.values()]), F.col("measure") + 1)
    at = lambda level: F.min(F.when(F.col("seen") * 1000 >= F.col("all") * level, F.col("bucket")))
    out = cells.groupBy(*keys).agg(at(1000 - of(4)).alias("a"), at(F.lit(500)).alias("m"), at(of(4)).alias("b"), F.max("all").alias("n"))
    # what shares a bucket with the quantile is within the fence
    out = out.select(*keys, "n", *[_value(F.col(c)).alias(c) for c in "amb"], _value(F.col("b"), True).alias("top"))
    low = F.when(of(3), F.col("a") - of(5) * (F.col("m") - F.col("a"))).otherwise(F.lit(-1))
    high = F.col("top") + of(5) * (F.col("b") - F.col("m"))
    return out.select(*by, "measure", "n", low.cast("double").alias("low"), high.cast("double").alias("high"))


def drawn(own: DataFrame, wide: DataFrame, by: list[str]) -> DataFrame:
    """own with its fences drawn towards those of the wider group (by..., measure) that holds it."""
    wide = wide.select(*[F.col(c).alias(f"_{c}") for c in (*by, "measure")], F.col("low").alias("_low"), F.col("high").alias("_high"))
    same = F.col("measure") == F.col("_measure")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    mean = lambda side: ((F.col("n") * F.col(side) + F.lit(float(WEIGHT)) * F.col(f"_{side}")) / (F.col("n") + F.lit(float(WEIGHT)))).alias(side)
    return own.join(wide, same).select(*[c for c in own.columns if c not in ("low", "high")], mean("low"), mean("high"))


def thresholds(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, low, high): arrays of the fences of each group, in the order of MEASURES."""
    whole = fences(cells, [])
    wide = scratch.save(drawn(fences(cells, ["lang"]), whole, []), "wide")
    own = drawn(fences(cells, ["lang", "source"]), wide, ["lang"])
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("measure", c))), lambda x: x[c]).alias(c)
    return scratch.save(own.groupBy("lang", "source").agg(pick("low"), pick("high")), "own")


def judged(rows: DataFrame, scratch: Scratch, lang: str, source: str, c: str = "counts", verdict: str = "kept") -> DataFrame:
    """rows, which have counts c, with a boolean: the base rule holds and every measure is within its fences.

    Only rows that pass the base rule enter the sketches: what fails it has no say in what is usual.
    """
    good = rows.where(~base_failed(c)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *measured(c))
    limits = thresholds(scratch.save(sketch(good), "sketch"), scratch)
    l, s, low, high = (fresh(rows, f"fence_{n}") for n in ("lang", "source", "low", "high"))
    # every row that passes the base rule has a group there; broadcast only while Spark finds it small
    out = rows.join(limits.toDF(l, s, low, high), F.col(lang).eqNullSafe(F.col(l)) & F.col(source).eqNullSafe(F.col(s)), "left")
    kept = ~base_failed(c)
    for i, (x, (top, bottom, scale, two, level, reach)) in enumerate(zip(measured(c), MEASURES.values())):
        inside = x.between(F.get(low, F.lit(i)), F.get(high, F.lit(i)))
        if not two:
            usual = F.get(high, F.lit(i)) * F.col(f"{c}.{bottom}") / F.lit(float(scale))
            inside = inside | (F.col(f"{c}.{top}") <= usual + F.lit(float(reach)) * F.sqrt(usual + F.lit((1000 - level) / 1000)))
        kept = kept & F.coalesce(inside, F.lit(True))
    return out.select(*[F.col(f"`{f}`") for f in rows.columns], kept.alias(verdict))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts and the verdict of each row, without its text."""
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = scratch.save(counted(slim).select("doc_id", "lang", "source", "counts"), "counts")
    out = judged(rows, scratch, "lang", "source")
    return out.select("doc_id", *[F.col(f"counts.{k}").alias(k) for k in COUNTS[:5]], base_failed("counts").alias("base_failed"), "kept", *[F.col(f"counts.{k}").alias(k) for k in COUNTS[5:]])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    scratch = Scratch(docs.sparkSession, "quality")
    c, verdict = fresh(docs, "quality_counts"), fresh(docs, "quality_kept")
    rows = scratch.save(counted(docs, name=c), "rows")
    return judged(rows, scratch, "lang", "source", c, verdict=verdict).where(F.col(verdict)).select(*[F.col(f"`{x}`") for x in docs.columns])
