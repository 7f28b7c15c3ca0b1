import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rng():
    return random.Random(4)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one id with two texts, a very long text, odd characters."""
    rng = random.Random(9)
    long = "\n".join(words(rng, 200) + "." for _ in range(120)) + " " + "x" * 20_000 + " " + "1" * 5_000 + " @" * 500
    rows = [
        (1, words(rng, 80), "en", "a", 1), (1, words(rng, 80), "en", "a", 1), (2, None, None, None, None), (None, words(rng, 60), "de", "b", 2), (3, "", "en", "a", 0),
        (4, " \n\t \n", "en", "a", 5), (5, "same text here", "en", "a", 3), (5, "same text here", "en", "a", 3), (6, long, "en", "a", len(long)), (7, "a b c\x1cd <|endoftext|> 'll don't 日本 🙂\r\n\x00", "fr", "c", 9), (8, "one two three", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like results."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "size", "score", "predicted", "kept", "component_id", "n_tokens", "start", "version", "line", "h", "u", "bucket", "hub", "item_id", "spans", "entropy"]
    return odd.select("*", *[F.lit(7).alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    got = df.select(*columns) if columns else df
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture(scope="session")
def same_rows():
    def check(run, odd, clashing, empty, *columns):
        """An operator gives rows for odd documents, the same ones beside clashing names, and none for none."""
        first = rows(run(odd), *columns)
        assert first == rows(run(clashing), *columns)
        assert run(empty).count() == 0
        return first

    return check
