import pytest

SCHEMA = "text string, doc_id long, fingerprint string, component_id int, keep_id string, row long, salt string, sha string, score double, h int"


@pytest.fixture
def table(spark):
    """Documents with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(t, i, "x", 1, "y", 7, "z", "w", 0.5, 3) for i, t in rows], SCHEMA)

    return make


#: (doc_id, text): nulls, empty and white texts, ties, repeated rows, a very long text.
ODD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "One two three four five."),
    (4, "One two three four five."),
    (5, "One  two three four\nfive."),
    (6, "Onetwo threefourfive."),
    (None, "One two three four five."),
    (7, "a"),
    (8, "A"),
    (9, "é ß 日本 😀 x"),
    (10, "word " * 30_000),
    (11, "x" * 100_000),
]


@pytest.fixture
def odd():
    return list(ODD)
