"""The text hits of a query stand in only where it has no vector hit."""

from loambase.operators import search
from loambase.plans import catalogue


def test_hybrid_search(spark):
    sf = "/root/testdata/sf0.001"
    vector = {tuple(r) for r in catalogue.mmr_search(spark, sf).collect()}
    text = {tuple(r) for r in catalogue.tfidf_search(spark, sf).select("query", "doc", "score", "rank").collect()}
    have = {r[0] for r in vector}
    assert any(q % 100 for q in have)
    got = {tuple(r) for r in catalogue.hybrid_search(spark, sf).collect()}
    assert got == {(*r, "embedding") for r in vector} | {(*r, "tfidf") for r in text if r[0] not in have}


def test_hybrid_fall_back(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6])], "doc long, vector array<double>")
    queries = spark.createDataFrame([(50, [1.0, 0.1]), (60, [-1.0, -1.0])], "query long, vector array<double>")
    found = search.mmr(search.vector_candidates(corpus, queries).join(corpus, "doc"))
    text = spark.createDataFrame([(50, 7, 0.5, 1), (60, 8, 0.5, 1)], "query long, doc long, score double, rank long")
    got = {(r["query"], r["doc"], r.method) for r in search.hybrid(found, text).collect()}
    assert got == {(50, 1, "embedding"), (50, 2, "embedding"), (60, 8, "tfidf")}
