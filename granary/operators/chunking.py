"""Tables made of text: chunks, lines, headed sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T


def pieces(c: Column, size: int, overlap: int, drop_contained_tail: bool = False) -> Column:
    """Array of chunks: one every size - overlap characters (one at least). Empty text: none. size <= 0: the text itself."""
    none = F.array().cast("array<string>")
    if size <= 0:
        return F.when(F.char_length(c) > 0, F.array(c)).otherwise(none)
    step = max(1, size - overlap)

    def made(t: Column) -> Column:
        last = F.char_length(t) - 1
        if drop_contained_tail and overlap > 0:
            last = F.greatest(F.lit(0), F.char_length(t) - F.lit(max(1, min(overlap, size - 1)) + 1))
        # a piece is cut from its own stretch of some steps, as a substring is counted from the start
        far = 32 * step
        stretch = F.transform(F.sequence(F.lit(0), last, F.lit(far)), lambda s: F.struct(s.alias("at"), F.substring(t, s + 1, F.lit(far + size)).alias("t")))
        own = lambda s: F.transform(F.sequence(F.lit(0), F.least(F.lit(far - step), last - s["at"]), F.lit(step)), lambda i: F.substring(s["t"], i + 1, F.lit(size)))
        return F.when(F.char_length(t) == 0, none).otherwise(F.flatten(F.transform(stretch, own)))

    return T.let(c, made)


def chunk(docs: DataFrame, size: int = 900, overlap: int = 120, text: str = "text", drop_contained_tail: bool = False) -> DataFrame:
    """docs with chunk_idx, n_chunks and chunk; a text without chunks has one empty chunk. A null text is empty."""
    made = pieces(F.coalesce(F.col(text), F.lit("")), size, overlap, drop_contained_tail)
    made = T.let(made, lambda m: F.when(F.size(m) == 0, F.array(F.lit(""))).otherwise(m))
    # the array goes through a generator of one row, so it is made once however often it is named
    rows = docs.select("*", F.explode(F.array(made)).alias("_chunks"))
    return rows.select(*docs.columns, F.size("_chunks").alias("n_chunks"), F.posexplode("_chunks").alias("chunk_idx", "chunk"))


def chunk_path(path: Column, idx: Column, n: Column) -> Column:
    """path itself for a single chunk, else with .partNNN before the suffix (from 1)."""
    parted = F.concat(F.regexp_replace(path, r"\.txt$", ""), F.format_string(".part%03d.txt", idx + 1))
    return F.when(n == 1, path).otherwise(parted)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_blank: bool = False) -> DataFrame:
    """(key, line_no from 1, line): stripped lines; blank ones count but are left out unless asked for."""
    rows = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    rows = rows.select(key, (F.col("at") + 1).alias("line_no"), T.strip(F.col("line")).alias("line"))
    return rows if keep_blank else rows.where("line <> ''")


def line_id(path: Column, line_no: Column, full_path: bool = True) -> Column:
    """path:line; with full_path=False by the file's name alone, which files in two folders can share."""
    return F.concat_ws(":", path if full_path else T.basename(path), line_no.cast("string"))


def front_matter(c: Column) -> tuple[Column, Column]:
    """The YAML block at the head of a text, or null, and the body below it."""
    pattern = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    head = F.regexp_extract(c, pattern, 1)
    return F.when(c.rlike(pattern), head), F.regexp_replace(c, pattern, "")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 900, overlap: int = 120) -> DataFrame:
    """(key, section, heading, part, chunk): split at Markdown headings; a section over `size` is chunked."""
    parts = F.split(F.col(text), r"(?m)(?=^#{1,6} )")
    rows = docs.select(F.col(key), F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("section", "body"))
    rows = rows.withColumn("heading", F.regexp_extract("body", r"^#{1,6} +([^\n]*)", 1))
    made = F.when(F.char_length("body") <= size, F.array("body")).otherwise(pieces(F.col("body"), size, overlap))
    return rows.select(key, "section", "heading", F.posexplode(made).alias("part", "chunk"))
