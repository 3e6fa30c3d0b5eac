import os

import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables are not here")
    return FOLDER


@pytest.fixture
def docs(spark):
    """A table of documents from texts, or from (doc_id, text) or whole rows."""

    def make(*rows):
        out = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            out.append((*row, *(None, "s", 0)[len(row) - 2 :]) if len(row) < 5 else row)
        return spark.createDataFrame(out, DOCS)

    return make
