import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table from (doc_id, text[, lang]) rows, with an extra column of a clashing name."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
