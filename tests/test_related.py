"""Bullets in brackets, of which the given tables have few, against the query's SQL."""

import duckdb
import pytest

from loambase.plans import catalogue, vault  # noqa: F401

TOPICS = ["[[Kept As Is]]", "[A label](http://x/y)", "[a](b) c (d)", "[x] (y)", "plain (in brackets)", "", "[]()", "[[a]] and [[b]]", "[a](b)](c)", "x[0]", None]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(TOPICS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    for name in ("labels", "embeddings"):
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    return tmp_path


def test_bullets_in_brackets(spark, folder):
    duck = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = catalogue.QUERIES["related_rewrite"](spark, str(folder)).select("doc_id", "linked", "stripped").collect()
    want = duck.sql(f"SELECT doc_id, linked, stripped FROM ({catalogue.ORACLES['related_rewrite']})").fetchall()
    assert len(want) == len(TOPICS) and sorted(map(tuple, got), key=str) == sorted(want, key=str)
