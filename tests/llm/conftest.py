import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows):
        schema = "doc_id long, text string, digest string, n int, block long, words string, Score double, _kept_id long, _id string, ids string"
        return spark.createDataFrame([(i, text, "d", 1, 2, "w", 0.5, 4, "i", "1") for i, text in rows], schema)

    return make
