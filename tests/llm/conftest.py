import pytest
from pyspark.sql import Row

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def frame(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names clash with those used inside."""
    schema = "doc_id long, text string, source string, size int, key int, key2 string, n int, c string, row int, start int, spans string"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", 4, 5, "z") for r in rows], schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, other scripts."""
    base = prose(1, 120)
    rows = [
        (1, None, None),
        (2, "", "b"),
        (3, "   \n\t ", "b"),
        (4, base, "a"),
        (5, base, "a"),
        (5, base, "a"),
        (6, base.upper(), "a"),
        (7, base + " more words here", None),
        (None, prose(2, 30), "b"),
        (None, None, "b"),
        (8, prose(3, 40_000), "c"),
        (9, "naïve Ünïcode ÀÉ " * 40, "c"),
        (10, "one two", "c"),
        (11, "a" * 3000, "d"),
        (12, prose(4, 60), "d"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


__all__ = ["Row", "by_id", "frame", "prose"]
