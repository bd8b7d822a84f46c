from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
# Names that the operators use themselves; they must not get in the way.
CLASHING = "row long, _id string, text_key string, score string, spans string, node string, block string, size string"


def documents(spark, rows: list[tuple]):
    """(doc_id, text, source) rows with columns whose names clash with the operators'."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame([(i, t, None, s, None, 7, *["x"] * 7) for i, t, s in rows], schema)


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, ties, repeated rows, very short and very long texts."""
    long = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
    base = " ".join(f"tok{k}" for k in range(60))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"),
        (6, "One two", "a"), (7, base, "a"), (8, base.replace("tok30", "other"), None), (9, base.upper(), "c"),
        (10, long, "a"), (11, long + " end", "b"), (None, base, "a"), (None, None, None), (12, "ÄÖ ñandú éa", "c"),
        (13, "a b c", "c"), (14, " a  b\tc ", "c"), (15, "a\u00a0b c", "b"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])
