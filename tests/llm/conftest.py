import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, _part string, _row string, kept string, h string, `a b` string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


EDGES = [
    (3, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n ", None, None, 4), (4, "one", "en", "", 3), (4, "one", "en", "", 3),
    (5, "the cat and the dog of the house " * 40, "en", "b", 0), (6, "the cat and the dog of the house " * 40, "en", "b", 0),
    (None, "no id here 😀 é", "en", "b", 0), (None, None, None, None, None), (7, "mail me: a.b@c.de or +49 (30) 123-4567, now", "de", "z", 0),
    (8, "\n".join(f"line {i} of the long text and more of it" for i in range(20000)), "en", "z", 0), (9, "x" * 300000, "en", "z", 0)]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash with working names."""
    return spark.createDataFrame([(*r, "s", "p", "r", "k", "h", "x") for r in EDGES], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
