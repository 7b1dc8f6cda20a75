import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
