import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def frame(spark):
    """Rows of ``(doc_id, text, source)`` as documents, with columns that clash with inner names."""

    def make(rows, lang="en"):
        full = [
            (i, t, lang, s, None if t is None else len(t), 7, "x")
            for i, t, s in rows
        ]
        return spark.createDataFrame(
            full,
            "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, root string",
        )

    return make


#: Null, empty, blank, repeated and long texts; a null and a repeated identifier.
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "same text of five words", "a"),
    (4, "same text of five words", "a"),
    (None, "same text of five words", "b"),
    (None, None, None),
    (5, "wörd " * 30000, "c"),
    (6, "x" * 150000, "c"),
]


@pytest.fixture
def odd():
    return list(ODD)
