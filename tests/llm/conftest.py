import random

import pytest

WORDS = "the river house stone walks green under over light between morning quiet table seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, copies, and columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [
        (1, prose(rng, 300), "en", 5),
        (2, None, None, None),
        (3, "", "en", 1),
        (4, "   \t\n ", "fr", 1),
        (5, long, "en", 2),
        (6, long + " tail", "en", 2),
        (7, "!!! 123", None, 3),
        (8, "日本語 テキスト é́ ΑΣ İ", "ja", 3),
        (None, prose(rng, 50), "en", 4),
        (None, None, None, None),
    ]
    same = prose(rng, 80)
    rows += [(10, same, "en", 9), (11, same, "en", 9), (12, same.upper(), "en", 9), (1, rows[0][1], "en", 5)]
    # names that the operators use inside
    return spark.createDataFrame([(*r, "x", 0, 1.5, [1]) for r in rows], "doc_id long, text string, lang string, n_chars long, id string, fp long, spans double, items array<int>")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
