import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Makes texts of invented words; the same seed gives the same text."""

    def make(seed, n=60):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ka", "lo", "mi", "Te", "ru", "é", "sha", "7"]) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators use inside."""
    rows = [(1, prose(1), "x"), (1, prose(1), "x"), (2, None, None), (3, "", "y"), (4, " \n\t ", "z"), (5, "One", ""), (None, prose(2), "n"), (6, prose(3, 30000), "l"), (7, "it's 12 o'clock — done!  \n\n ok", "")]
    return spark.createDataFrame([(*r, i, 0, "c") for i, r in enumerate(rows)], "doc_id long, text string, source string, fp long, score int, cell string")
