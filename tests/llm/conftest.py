from __future__ import annotations

import sys

import pytest

COLUMNS = "doc_id long, text string, lang string, `a.b` int"
LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows and a column name with a dot."""
    rows = [(1, "One two three four five six seven.", "en", 1), (2, None, None, None), (3, "", "en", 3), (None, "no id here", "en", 4), (5, LONG, "en", 5), (6, " \t\n", "de", 6), (7, "Ünï çödé 漢字 \U0001f600", "fr", 7)]
    return spark.createDataFrame([*rows, rows[0], rows[0]], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def lines_run():
    """How many lines of this library a call runs: work that a busy machine does not change."""

    def count(f, *args):
        n = 0

        def within(frame, event, _):
            nonlocal n
            n += event == "line"
            return within

        def entered(frame, event, _):
            return within if "caretide" in frame.f_code.co_filename else None

        before = sys.gettrace()
        sys.settrace(entered)
        try:
            f(*args)
        finally:
            sys.settrace(before)
        return n

    return count
