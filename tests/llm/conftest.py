"""Small tables with every awkward row."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty, blank, long and repeated texts, clashing names."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "x", "y"),
        (2, None, "en", "a", None, None, None),
        (3, "", None, None, 0, "x", "y"),
        (4, " \n\t ", "de", "b", 4, "x", "y"),
        (5, "12 34 .. --", "de", "b", 11, "x", "y"),
        (6, long, "en", "c", len(long), "x", "y"),
        (7, "one two three four five six seven", "en", "a", 33, "x", "y"),
        (7, "one two three four five six seven", "en", "a", 33, "x", "y"),
        (None, "no id here but some words", None, None, None, "x", "y"),
        (8, None, None, None, None, None, None),
        (9, "mail me at a.b@c.example.org or +1 555 123 4567 \U0001f600", "en", "c", 50, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
