"""Documents with every awkward case, as rows and as a DataFrame."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, digest string, score double, _key string, kept string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward():
    """(doc_id, text): nulls, empty, white space, very long, repeated, tied and multilingual texts."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\r\x0b\x0c"),
        (4, "one"),
        (5, "One"),
        (6, base),
        (7, base),
        (8, base.upper()),
        (9, base + " tail"),
        (10, words(rng, 30_000)),
        (11, "x" * 200_000),
        (12, "word " * 5000),
        (13, "日本語のテキスト 中文 العربية हिन्दी 😀🏽 é     \x00 \x1c \x85"),
        (14, "don't I'LL we've ΟΔΟΣ İstanbul <|endoftext|> <|startoftext|> 12½ ~ a~b"),
        (15, "é" * 5000),
        (16, "a, b. c,d .. ,"),
        (None, base + " nobody"),
        (None, None),
        (18, words(rng, 200)),
        (18, None),
    ]
    return rows + [rows[5]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, [1], "d", 0.5, "k", "z") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []).coalesce(1)
