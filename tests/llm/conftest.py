import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with
    those the operators use inside."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, "x", 2.0) for r in rows]
        schema = "doc_id long, text string, source string, h1 string, n long, spans string, key double"
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def hostile(docs_of):
    """Nulls, empty and very long texts, ties and repeated rows in one table."""
    long = prose(99, sentences=3000)
    rows = [
        (1, prose(1)), (2, prose(1)), (3, None), (4, ""), (None, prose(1)), (5, "word"), (6, long), (7, long),
        (8, prose(2), None), (8, prose(2), None), (-9, "ÄÖ ßtraße 漢字 \U0001f600 end"), (10, " \n\t "), (None, None, None),
    ]
    return docs_of(*rows)
