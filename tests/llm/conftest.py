"""Small awkward tables for the corpus operators."""

import pytest

LONG = "word " * 30_000 + "x" * 20_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The quick\t\n brown fox jumps over the lazy dog", "en", None),
    (2, "The quick brown fox jumps over the lazy dog", "en", "b"),
    (3, "the quick brown fox jumps over the lazy dog!", None, "b"),
    (4, None, "en", "c"),
    (5, "", "de", "c"),
    (6, " \n\t ", "de", "c"),
    (None, "no identifier but a text", "en", "c"),
    (None, None, None, None),
    (7, LONG, "en", "d"),
    (8, LONG, "en", "d"),
    (9, "über straße größe und noch mehr wörter für die sprache", "de", "d"),
    (9, "über straße größe und noch mehr wörter für die sprache", "de", "d"),
    (10, "12 345 --- !!! ...", "fr", "e"),
    (11, "don't we'll they've I'm 's  'T x y  z 中文字 😀👍 é", "en", "e"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, blanks, repeated rows and identifiers, long texts, and columns whose names clash."""
    rows = [(*r, i, "x", i % 2 == 0, 1.5) for i, r in enumerate(ROWS)]
    columns = (
        "doc_id long, text string, lang string, source string, "
        "row long, digest string, kept boolean, score double"
    )
    return spark.createDataFrame(rows, columns).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
