import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with other columns whose names clash with inner ones."""

    def make(rows, **more):
        schema = "doc_id long, text string, n long, name string, h string, block int, source string"
        return spark.createDataFrame([(i, t, 1, "x", "y", 2, "s") for i, t in rows], schema)

    return make
