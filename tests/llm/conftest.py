import random

import pytest

WORDS = "the of and tion shore mill grain bridge lantern copper winter signal harbour meadow stone river amber violet".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_rows():
    """Rows that every operator takes: nulls, empty, blank, short, long and repeated texts."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    return [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "fr", "b"), (4, "one two", "en", "a"), (5, long, "de", "a"), (6, long, "de", "b"), (7, "x" * 50_000, "en", None), (None, "no id at all here", "en", "a"), (8, "same row", "en", "a"), (8, "same row", "en", "a")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, 1.0) for r in odd_rows], "doc_id long, text string, lang string, source string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
