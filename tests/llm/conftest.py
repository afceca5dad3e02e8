import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(6000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta. " * 30, "en", "s1", 1),
        (1, "Alpha beta gamma delta epsilon zeta eta theta. " * 30, "en", "s1", 1),
        (2, "Alpha beta gamma delta epsilon zeta eta theta. " * 30, None, "s2", None),
        (3, None, "en", None, None),
        (4, "", "fr", "s1", 0),
        (5, " \n\t ", "fr", "s1", 4),
        (6, long, "de", "s3", 2),
        (7, long + " end", "de", "s3", 2),
        (None, "one two three", "en", "s1", 3),
        (None, None, None, None, None),
        (8, "a" * 3000, "en", "s2", 3000),
        (9, "Éa ß\x00 <|endoftext|> x’s don't", "es", "s2", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, k long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
