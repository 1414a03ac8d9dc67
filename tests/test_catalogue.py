"""Queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skeinworks.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The dearer queries share their plan with these.
CHOSEN = [n for n in catalogue.ORACLES if not n.startswith("semantic_query_") or n == "semantic_query_then"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(frame):
    show = lambda x: None if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(int(x)) if hasattr(x, "__int__") and not isinstance(x, str) else str(x)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(show(x) for x in r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
