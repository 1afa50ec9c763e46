from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, row string, at double, key int, component string, h string, hash string"
)
PROSE = (
    "The river rose in the night and by morning the lower field was under water. Nobody had seen it come so fast, "
    "not even old Martha, who had lived beside it for eighty years and kept a notebook of every flood since the war."
)
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(6000))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use too."""
    extra = (True, "r", 1.5, 7, "c", "h", "x")
    rows = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", "s", 4),
        (4, "word", "en", None, 4),
        (5, "again " * 20000, "en", "s", 120000),
        (6, PROSE, "en", "s", len(PROSE)),
        (7, PROSE.upper(), None, "s", len(PROSE)),
        (8, PROSE, "en", "s", len(PROSE)),
        (9, LONG, "en", "s", len(LONG)),
        (10, "Ünïcödé   ñandú \U0001f600 \x00 \x1c x", "es", "s", 9),
        (11, PROSE + " " + LONG[:3000], "en", "s", 10),
    ]
    return [r + extra for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def twice(spark):
    """Repeated rows: the same id with the same text, and with another."""
    rows = odd_rows()
    other = (6, "Something else entirely " + LONG[:900]) + rows[5][2:]
    return spark.createDataFrame([*rows, rows[5], rows[8], other, (None, PROSE) + rows[5][2:]], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
