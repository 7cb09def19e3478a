import random

import pytest

WORDS = [a + b for a in ("th", "re", "on", "ing", "sta", "ne", "pla", "mo") for b in ("er", "an", "o", "", "ti", "es")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows that operators must bear: nulls, empties, blanks, long texts, repeats, odd characters."""
    rng = random.Random(4)
    long = prose(rng, 20_000)
    return [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", None, 7),
        (4, "word", "en", "a", 4),
        (5, long, "en", "b", len(long)),
        (6, "same words in this row here", "en", "b", 27),
        (6, "same words in this row here", "en", "b", 27),
        (None, "same words in this row here", None, None, None),
        (None, None, None, None, None),
        (7, "naïve façade 日本 😀 ﬁ \x00 \x1c end x", "fr", "c", 30),
        (8, "SAME words IN this row here", "en", "c", 27),
        (9, "a\nb\n\nb\na  a", "en", "c", 11),
    ]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents, optionally with columns that are named like results."""

    def build(rows, extra=False):
        df = spark.createDataFrame(rows, COLUMNS)
        if extra:
            from pyspark.sql import functions as F

            for name in (
                "n_tokens", "ids", "spans", "base", "score", "class", "n", "size", "number", "begin",
                "token", "key", "row", "place", "parts", "words", "failures", "predicted", "trip",
            ):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
