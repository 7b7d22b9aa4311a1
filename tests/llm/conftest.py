import random

import pytest

from flockmetrics.llm import package

AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "é"), (6, "word " * 30_000), (7, "a" * 50_000),
    (8, "same text"), (8, "same text"), (9, "same  text"), (None, "no id here"), (None, "no id here"), (None, None),
    (10, "😀 a\x00b \x1c ſecret İ Σ"), (11, "|" * 500),
]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    package.send(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank, long, repeated and odd texts; columns whose names clash with results."""
    rows = [(i, t, "en", "s", 0, 0.5, "x", 1, 2) for i, t in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, kept int, f int"
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def prose():
    """A maker of texts: words from a small vocabulary."""
    def make(seed, n, words=400):
        rnd = random.Random(seed)
        vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(words)]
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    return make
