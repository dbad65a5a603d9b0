"""Every registered query of the domain tables against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from loambase.plans import catalogue, files_and_streams, reports, vault  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, (bool, np.bool_)):
        return repr(round(float(v), 6))
    return str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_without_llm(monkeypatch):
    import importlib
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("loambase.llm", "corpus_pipeline")) else real(n, *a))
    again = importlib.reload(entry)
    assert again.queries().keys() == catalogue.QUERIES.keys()
    monkeypatch.undo()
    importlib.reload(entry)
