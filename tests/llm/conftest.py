import pytest

from lodestone.llm import common

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return common.read(spark, sf, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "one two three four five six", "en", None, 5),
        (3, "one two three four five six", "en", "a", 5),
        (3, "one two three four five six", "en", "a", 5),
        (4, " \t\n ", "en", "b", 4),
        (5, "word " * 30_000, "en", "b", 9),
        (6, "é" * 5_000, None, "b", 9),
        (7, "solo", "en", "a", 4),
        (8, "SOLO", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
