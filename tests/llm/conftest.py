"""Helpers of the training-data tests; the Spark session is that of the other tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    from ledgerlens.llm.support import ready

    def make(rows, schema=DOCS):
        """Documents from (doc_id, text) or whole rows."""
        rows = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        return ready(spark).createDataFrame(rows, schema).repartition(3)

    return make


ODD = [
    (None, "a row without an id"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "same text twice"),
    (4, "same text twice"),
    (5, "word " * 30_000),
    (6, "x" * 60_000),
    (7, "1" * 30_000 + " " + "1.2.3." * 5_000 + "@" * 100),
]


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD)
