import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS string, row string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "extra", "other") for r in rows]
        return spark.createDataFrame(full, T.StructType.fromDDL(SCHEMA))
    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d"), (None, "a lone text without an id"),
            (None, "another text without an id"), (6, long), (7, long + " more"), (8, "same text " * 30),
            (8, "same text " * 30), (9, "same text " * 30), (10, "Ünïcödé wörds änd 漢字 \x0b here"), (11, "\n\n\n")]
