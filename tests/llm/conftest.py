"""Documents with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import Row

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `row` string, key string, ids string, "
    "score double, n_words int, spans int, block long, fp long, kind string"
)


def text(seed: int, n: int, vocabulary: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def rows(texts):
    """(doc_id, text) with the other columns filled in."""
    return [
        (i, t, "en", "s", None if t is None else len(t), "r", "k", "i", 0.5, 1, 2, 3, 4, "kind") for i, t in texts
    ]


ODD = [
    (1, text(1, 120)), (2, None), (3, ""), (4, " \t\n "), (5, text(5, 30_000, 5000)), (6, text(1, 120)),
    (6, text(1, 120)), (None, text(7, 50)), (None, None), (7, "Ünï ▁ \x00 cödé  two  spaces"), (8, "one"),
    (9, text(9, 20) + " " + text(1, 60) + " " + text(10, 20)), (10, "a a a a " * 40), (11, text(11, 34)), (12, text(12, 35)),
    (13, text(12, 35) + " tail"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(ODD), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts):
        return spark.createDataFrame(rows(texts), SCHEMA)

    return make


def by_id(frame, *columns):
    """Sorted rows, nulls first."""
    found = [tuple(r) for r in frame.select(*columns).collect()]
    return sorted(found, key=lambda r: [(v is not None, v) for v in r])


def as_rows(found: list[Row]) -> list[tuple]:
    return [tuple(r) for r in found]
