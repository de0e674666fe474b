import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang), with columns whose names operators use themselves."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) + ((7, "x", None, True) if extra else ()) for r in rows]
        return spark.createDataFrame(full, DOCUMENT + (", key long, `a.b` string, leaks string, kept boolean" if extra else ""))

    return make
