import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, one very long text, repeated rows and ties.
ODD = [
    (1, "", "en", "s1", 0), (2, None, None, None, None), (3, " \n\t ", "en", "s1", 4), (4, "one two three", "en", "s2", 13),
    (5, "released under the MIT License. " * 20, "en", "s2", 1), (5, "released under the MIT License. " * 20, "en", "s2", 1),
    (6, "word " * 30_000, "en", "s3", 150_000), (7, "x" * 50_000, "en", None, 50_000), (None, "no id at all", "en", "s1", 12), (8, "one two three", "en", "s2", 13),
]


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns whose names operators might use."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'z' AS w", "1 AS t", "2 AS of", "3 AS size", "4 AS at", "'k' AS k", "5 AS fp", "6 AS named", "7 AS mark")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
