import random

import pytest

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 6)) for i in range(400)]


@pytest.fixture(scope="session")
def prose():
    """A function of (seed, n): n words of invented text."""
    return lambda seed, n: " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="session")
def documents(spark, prose):
    """A function from (doc_id, text) rows to a table of documents with a column whose name clashes."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")

    return make
