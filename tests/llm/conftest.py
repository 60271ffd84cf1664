import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text), with a clashing extra column and an empty table on request."""

    def make(*texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "x", i) for i, t in zip(ids, texts)], "doc_id long, text string, word string, c0 long")

    return make
