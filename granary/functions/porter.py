"""The Porter stemmer (1980), from the published rules; run it on a vocabulary, not on a corpus."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix lists of the published algorithm, steps 2 to 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class _Letters(dict):
    def __missing__(self, letter: int) -> str:
        return "c"


_LETTERS = _Letters({ord(v): "v" for v in "aeiou"})


def _by_size(rules: list[tuple[str, str]]) -> list[tuple[int, dict[str, str]]]:
    """The rules by the size of their suffixes, the longest first."""
    return [(n, {old: new for old, new in rules if len(old) == n}) for n in sorted({len(old) for old, _ in rules}, reverse=True)]


_RULES2, _RULES3, _RULES4 = (_by_size(rules) for rules in (STEP2, STEP3, [(old, "") for old in STEP4]))


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel, at each letter."""
    if "y" not in word:
        return word.translate(_LETTERS)
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _suffix(word: str, rules: list[tuple[int, dict[str, str]]]) -> tuple[str, str] | None:
    """The longest suffix that fits, and what stands for it."""
    for n, of in rules:
        new = of.get(word[-n:])
        if new is not None:
            return word[-n:], new
    return None


def _swap(word: str, rules: list[tuple[int, dict[str, str]]], least: int) -> str:
    """The longest suffix that fits decides, whether or not its stem is long enough."""
    found = _suffix(word, rules)
    if found is None:
        return word
    base = word[: len(word) - len(found[0])]
    return base + found[1] if _measure(base) > least else word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            base = word[: len(word) - len(old)]
            if word.endswith(old) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif _double(base) and base[-1] not in "lsz":
                    word = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    word = base + "e"
                else:
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _RULES2, 0), _RULES3, 0)
    if found := _suffix(word, _RULES4):
        base = word[: len(word) - len(found[0])]
        if _measure(base) > 1 and (found[0] != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(token: str) -> str:
    """Case and diacritics away, then the stem."""
    if token.isascii():
        return stem(token.lower())
    plain = "".join(c for c in unicodedata.normalize("NFD", token.casefold()) if not unicodedata.combining(c))
    return stem(plain)


@F.pandas_udf(StringType())
def stemmed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else fold(t))
