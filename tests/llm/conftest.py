import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, __row string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from (doc_id, text, lang, source), with extra columns whose names clash."""

    def make(rows):
        return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = "word " * 60_000 + "cc by " * 300
    rows = [(1, None, None, None), (None, "A text, all rights reserved.", "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "fr", "b"), (4, "###", "fr", "b"), (5, long, "en", "a")]
    rows += [(6, "the same row twice " * 20, "en", "a")] * 2 + [(7, "the same row twice " * 20, "de", "b"), (7, "another text with that number " * 20, "de", "b")]
    return documents(rows)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
