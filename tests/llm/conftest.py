import pytest

EDGE_ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62, 7, "x"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62, 7, "x"),  # repeated row
    (2, None, "en", None, None, 1, None),
    (3, "", None, "b", 0, None, "y"),
    (4, " \t\n \r\x0b\x0c ", "en", "b", 8, 2, "z"),
    (None, "mail me at a.b@example.com now", "en", "a", 30, 3, "x"),
    (5, "ÉTÉ word " * 30_000, "fr", "c", 270_000, 4, "x"),
    (6, "short text", "en", "a", 10, 5, "x"),
    (7, "short text", "en", "a", 10, 5, "x"),  # a tie
]
# the columns of documents, and some whose names the operators could be tempted to use
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture
def texts(spark):
    def make(*own, sources=None):
        rows = [(i, t, "en", sources[i] if sources else "s", None if t is None else len(t)) for i, t in enumerate(own)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
