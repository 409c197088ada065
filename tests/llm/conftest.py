import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, Key int, score double"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t), "x", 1, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Plain, empty, null, white, one-word, very long, and repeated texts."""
    rng = random.Random(5)
    plain = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(30)]
    long = " ".join(rng.choices(words, k=60_000))
    return [*plain, None, "", " \t\n", "word", "two words", "Ünïcode — 文字", long, plain[0], plain[0], plain[1] + " tail"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with clashing extra columns, repeated rows, null ids and null sources."""
    rows = rows_of(texts)
    rows += [rows[0], rows[0], (None, texts[2], None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
