import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Cases every operator must bear: null in any column, empty and blank texts, repeated rows, odd white space, non-ASCII letters.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (None, "some words of a row without an id stand here to be read", "en", "a", 5),
    (5, "one", "en", "a", 3),
    (6, "ÀÉ one two three four Ünï çode ſK 漢字 😀 end. " * 3, "fr", "b", 9),
    (7, "a b c d e f g h i j k l m", "en", "b", 9),
    (7, "a b c d e f g h i j k l m", "en", "b", 9),
    (8, "line\nline\n \nline\r\nother # * $\n" * 2, "en", "b", 9),
    (9, "x " * 3000, "en", "b", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """n made-up texts of seeded random words."""

    def make(n, seed=1, vocabulary=400, least=5, most=120):
        r = random.Random(seed)
        v = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
        return [" ".join(r.choice(v) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(r.randint(least, most))) for _ in range(n)]

    return make
