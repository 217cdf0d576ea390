"""Text expressions. Native unless Spark has no built-in (NFKC, entities, fences)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns that the compared system uses.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
NUMBER = r"(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?%?"
ALIASES = [
    (r"\bpersian\b", "farsi"),
    (r"\bthe italian\b", "italian"),
    (r"\bitaliano\b", "italian"),
    (r"\bfārsi\b", "farsi"),
    (r"\bnative language\b", "farsi"),
]
WORD = r"([\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?)"
ROUGE_TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
QUERY_TERM = r"([0-9A-Za-z_]+)"
_CAPITAL = r"\p{Lu}[\p{L}\p{N}'-]*"
#: A run of capitalised words behind a word or comma, or any run of several.
NAME = rf"[\p{{Ll}}\p{{N}},;:)] +{_CAPITAL}(?: +{_CAPITAL})*|{_CAPITAL}(?: +{_CAPITAL})+"

_FENCE = re.compile(r"(^```.*?^```)|(^~~~.*?^~~~)", re.DOTALL | re.MULTILINE)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim() takes blanks only). Texts without any there are not searched; `$` also stands before a last line end."""

    def stripped(t: Column) -> Column:
        ends = F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
        return F.when(ends.rlike(r"[\s\x{85}\x{2028}\x{2029}]"), F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(t)

    return let(c, stripped)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def tidy(c: Column) -> Column:
    """Control characters out, runs of blanks to one, none at line ends, two line feeds in a row at most, ends stripped."""
    out = F.replace(one_blank(strip_control(c)), F.lit(" \n"), F.lit("\n"))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def one_blank(c: Column) -> Column:
    """Runs of blanks and tabs to one blank; single blanks, most of them, are left as they are."""
    return F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " ")


def _tidy_outside(part: str) -> str:
    part = re.sub(r"[ \t]+", " ", re.sub(CONTROL, "", part))
    return re.sub(r" +(?=\n)", "", part)


def normalize_string(text: str) -> str:
    """NFKC and entities everywhere; the white-space rules of `tidy` outside fenced code.

    Parts outside fences and fences take turns; a run of line feeds is counted across
    the parts outside as they are joined, so a fence is never looked into.
    """
    text = html.unescape(unicodedata.normalize("NFKC", text))
    out, at = [], 0
    for fence in [m.span() for m in _FENCE.finditer(text)] + [(len(text), len(text))]:
        plain = re.sub(r"\n{3,}", "\n\n", _tidy_outside(text[at : fence[0]]))
        last = fence[0] == len(text)
        out += [re.sub(r" +$", "", plain) if last else plain, text[fence[0] : fence[1]]]
        at = fence[1]
    return "".join(out).strip()


@F.pandas_udf(StringType())
def _normalize_rare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalize_string(t))


def is_plain(c: Column) -> Column:
    """Latin-1 letters and ASCII, without `&` or fences: NFKC, entities and fences can't change it."""
    letters = is_ascii(c) | c.rlike(r"^[\x00-\x25\x27-\x7fÀ-ž&&[^ĲĳĿŀŉ]]*$")
    return ~c.contains("&") & letters & ~c.contains("```") & ~c.contains("~~~")


def normalize_text(c: Column, native: bool = False) -> Column:
    """The whole normalisation: native for plain text, by Python for the rest. native: for text that is all known to be plain."""
    # the text that Python returns is null for plain text only, so it is told once which it is
    return tidy(c) if native else F.coalesce(_normalize_rare(F.when(~is_plain(c), c)), tidy(c))


@F.pandas_udf(StringType())
def light_clean(texts: pd.Series) -> pd.Series:
    """NFKC, entities, no control characters, ends stripped."""
    return texts.map(lambda t: None if t is None else re.sub(CONTROL, "", html.unescape(unicodedata.normalize("NFKC", t))).strip())


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """NFKC and entities only."""
    return texts.map(lambda t: None if t is None else html.unescape(unicodedata.normalize("NFKC", t)))


def fingerprint_form(c: Column, native: bool = False) -> Column:
    """The form in which near duplicates are compared: canonical, lower case, tidy blanks, aliases put in order."""
    out = strip_control(F.lower(c if native else canonical(c)))
    out = F.regexp_replace(one_blank(out), r"(?m) $", "")

    def aliased(t: Column) -> Column:
        put = t
        for pattern, new in ALIASES:
            put = F.regexp_replace(put, "(?iU)" + pattern, new)
        # in ASCII, lower case by now, an alias is found by its letters; others (long s) are equal to them without case
        some = t.contains("persian") | t.contains("italian") | t.contains("native language")
        return F.when(is_ascii(t) & ~some, t).otherwise(put)

    return strip(let(out, aliased))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_TOKEN), F.lit(1))


def numbers(c: Column) -> Column:
    """Numbers in order, without thousands separators and percent signs."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), "%+$", ""))


def numbers_preserved(a: Column, b: Column) -> Column:
    return F.array_sort(numbers(a)) == F.array_sort(numbers(b))


def names(c: Column) -> Column:
    """Named entities by their look: runs of capitalised words, in order, with repeats.

    A single capitalised word that begins a text or a sentence is no name.
    """
    return F.transform(F.regexp_extract_all(c, F.lit(NAME), F.lit(0)), lambda n: F.regexp_replace(n, r"^[^\p{Lu}]+", ""))


def new_names(source: Column, out: Column) -> Column:
    """The words of names in `out`, lower-cased and distinct, that are no words of `source`, whatever their case there."""
    said = F.flatten(F.transform(names(out), lambda n: words(F.lower(n))))
    return F.array_except(said, words(F.lower(source)))


def query_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUERY_TERM), F.lit(1))


def match_expression(c: Column) -> Column:
    """The safe full-text expression: each term quoted, all needed; an empty phrase when there are none."""
    terms = query_terms(c)
    return F.when(F.size(terms) == 0, F.lit('""')).otherwise(F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND "))


def preview(c: Column, width: int = 140) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, width)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once however often f names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens; k <= 1: the tokens; fewer tokens than k: none."""
    if k <= 1:
        return F.array_distinct(tokens)

    def runs(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(made))

    return let(tokens, runs)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def relative_to(path: Column, roots: list[str]) -> Column:
    """The path below the first root that holds it, else its last part."""
    out = basename(path)
    for root in reversed(roots):
        base = root.rstrip("/") + "/"
        out = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(out)
    return out


def cache_key(text: Column, style: Column, max_new_tokens: int) -> Column:
    body = F.format_string('{"v": "v1", "t": "%s", "s": "%s", "m": %d}', F.sha2(text, 256), F.sha2(style, 256), F.lit(max_new_tokens))
    return F.sha2(body, 256)
