import random

import pytest

SCHEMA = "doc_id long, text string, kept string, text_key string, n_words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names clash."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve"),
        (1, "one two three four five six seven eight nine ten eleven twelve"),
        (1, "another text under the same id, with quite some other words in it today"),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b\x0c\r "),
        (None, "a text without an id that says one thing or another about the weather"),
        (None, None),
        (5, " ".join(words)),
        (6, "x" * 200_000),
        (7, "same line\n" * 3000),
        (8, f"intro\n{passage}\noutro"),
        (9, f"start\n{passage}\nend"),
        (10, "tie"),
        (11, "tie"),
        (12, "ÄÖ ß 漢字   é \U0001f600 naïve İstanbul"),
    ]
    return spark.createDataFrame([(i, t, "kept", "key", "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
