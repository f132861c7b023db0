"""Registered queries vs their DuckDB oracles on sf0.001 (the driver does this at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tagflow.plans.catalog import ORACLES

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
NAMES = sorted(ORACLES)


def _norm(v):
    if v is None or v is __import__("pandas").NA:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_callable_and_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dk)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "pos", "tok", "tag", "tag_id"]
    assert df.count() > 0
