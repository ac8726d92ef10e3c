import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with the table's other columns."""

    def docs(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOCS)

    return docs
