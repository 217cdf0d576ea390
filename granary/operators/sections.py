"""Documents as trees of headed sections, cut and merged to a budget of tokens.

Everything is array expressions on a document's row: no line leaves its row before it is
part of a chunk, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

_SECTION = "struct<path:array<string>,body:string,tokens:int>"


def _once(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """keep and the columns made, each computed once however often later steps name it."""
    return rows.select(*[f"`{c}`" for c in keep], F.inline(F.array(F.struct(*[v.alias(c) for c, v in made.items()]))))


def tokens(c: Column) -> Column:
    """Number of words: runs of characters that are no white space."""
    return F.regexp_count(c, F.lit(r"\S+")).cast("int")


def _sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _all): the array of a document's sections, _SECTION each."""
    rows = docs.select(F.col(key).alias("_key"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    fence = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(r"^ {0,3}(```|~~~)"), i)), lambda i: i.isNotNull())
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})[ \t]+\S", 1))
    title = lambda x: F.regexp_replace(F.regexp_replace(x, r"^#{1,6}[ \t]+", ""), r"[ \t]+#*[ \t]*$", "")
    found = F.filter(F.transform("_lines", lambda x, i: F.named_struct(F.lit("at"), i, F.lit("level"), level(x), F.lit("title"), title(x))), lambda h: h["level"] > 0)
    rows = _once(rows, ["_key", "_lines"], _fences=fence, _found=found)
    rows = _once(rows, ["_key", "_lines"], _heads=F.filter("_found", lambda h: F.size(F.filter("_fences", lambda f: f < h["at"])) % 2 == 0))
    # the fold: a stack of open headings, and the titles on it at each heading
    start = F.named_struct(F.lit("open"), F.array().cast("array<struct<level:int,title:string>>"), F.lit("paths"), F.array().cast("array<array<string>>"))

    def push(state: Column, head: Column) -> Column:
        own = F.array(F.named_struct(F.lit("level"), head["level"], F.lit("title"), head["title"]))
        stack = F.concat(F.filter(state["open"], lambda o: o["level"] < head["level"]), own)
        return T.let(stack, lambda s: F.named_struct(F.lit("open"), s, F.lit("paths"), F.concat(state["paths"], F.array(F.transform(s, lambda o: o["title"])))))

    paths = F.aggregate("_heads", start, push, lambda s: s["paths"])
    lead = F.when(F.size("_heads") == 0, True).otherwise(F.try_element_at("_heads", F.lit(1))["at"] != 0)
    none = F.array(F.array().cast("array<string>"))
    rows = _once(rows, ["_key", "_lines"], _at=F.concat(F.when(lead, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.transform("_heads", lambda h: h["at"])), _paths=F.concat(F.when(lead, none).otherwise(F.array().cast("array<array<string>>")), paths))

    def cut(at: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at("_at", i + 2), F.size("_lines"))
        return T.strip(F.array_join(F.slice("_lines", at + 1, end - at), "\n"))

    bodies = F.transform("_at", cut)
    rows = _once(rows, ["_key", "_paths"], _bodies=bodies)
    made = F.transform("_bodies", lambda b, i: F.named_struct(F.lit("path"), F.element_at("_paths", i + 1), F.lit("body"), b, F.lit("tokens"), tokens(b)))
    return _once(rows.withColumnRenamed("_key", key), [key], _all=F.filter(made, lambda s: s["tokens"] > 0))


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, path, body, tokens): the text before the first heading, and each heading with what follows it.

    path: the titles from the outermost heading to the section's own; a heading closes those of
    its level and below. Lines in fences are no headings. Sections without a word are left out,
    and a null or empty text has none.
    """
    out = _sections(docs, key, text).select(key, F.posexplode("_all").alias("section", "_s"))
    return out.select(key, "section", "_s.path", "_s.body", "_s.tokens")


def chunks(docs: DataFrame, least: int = 40, most: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk_id, key, section_path, norm_text, token_count) of each document, between two sizes where it can be.

    In order, a chunk of fewer than `least` tokens takes in the next section if both have no
    more than `most`; it keeps its first section's path. Chunks of more than `most` are cut every
    `most` words. chunk_id: the key, and the chunk's number from 0.
    """
    rows = _sections(docs, key, text)

    def take(out: Column, s: Column) -> Column:
        one = F.named_struct(F.lit("path"), s["path"], F.lit("body"), s["body"], F.lit("tokens"), s["tokens"])
        last = F.try_element_at(out, F.lit(-1))
        both = F.named_struct(F.lit("path"), last["path"], F.lit("body"), F.concat(last["body"], F.lit("\n\n"), s["body"]), F.lit("tokens"), last["tokens"] + s["tokens"])
        fits = (F.size(out) > 0) & (last["tokens"] < least) & (last["tokens"] + s["tokens"] <= most)
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(one)))

    rows = _once(rows, [key], _merged=F.aggregate("_all", F.array().cast(f"array<{_SECTION}>"), take))
    word = lambda s: F.regexp_extract_all(s["body"], F.lit(r"\S+\s*"), F.lit(0))
    piece = lambda s: T.let(word(s), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(most)), lambda i: F.named_struct(F.lit("path"), s["path"], F.lit("body"), T.strip(F.array_join(F.slice(w, i + 1, most), "")), F.lit("tokens"), F.least(F.size(w) - i, F.lit(most)))))
    cut = F.flatten(F.transform("_merged", lambda s: F.when(s["tokens"] > most, piece(s)).otherwise(F.array(s))))
    rows = rows.select(key, F.posexplode(cut).alias("_n", "_s"))
    return rows.select(F.concat_ws("#", F.col(key).cast("string"), F.col("_n").cast("string")).alias("chunk_id"), key, F.array_join("_s.path", " / ").alias("section_path"), F.col("_s.body").alias("norm_text"), F.col("_s.tokens").alias("token_count"))
