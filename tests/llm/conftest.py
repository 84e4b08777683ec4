import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, shard string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose
    names clash with results."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "clash", "clash") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make
