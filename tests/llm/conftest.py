import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from {doc_id: text} or rows (doc_id, text)."""

    def make(texts):
        rows = texts.items() if isinstance(texts, dict) else texts
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make
