"""Links lost in crowded buckets, with and without splitting them; the pipeline on awkward rows."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from loambase.llm import lines, neardup, sharding, toxicity
from pyspark.sql import functions as F

from .test_llm import AWKWARD, table
from .test_rounds import family

SF = "/root/testdata/sf0.001"


def test_near_duplicates_split_buckets(spark):
    texts = {d: " ".join(w) for d, w in family(400, 344, 15, 41, lambda x: f"{x:x}").items()}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), limit=150).toPandas()
    by = dict(zip(got.doc_id, got.component_id, strict=True))
    assert all(by[d] in (d, d - d % 2) for d in by)
    assert sum(by[d] == by[d + 1] for d in range(0, 800, 2)) >= 396


@pytest.mark.parametrize(("families", "pairs", "limit"), [(40, 30, lines.LIMIT), (1, 150, 120)])
def test_fuzzy_lines_crowded(spark, families, pairs, limit):
    """At most one link in a hundred is lost among lines that share a template of their family."""
    texts, rng = {}, np.random.default_rng(5)
    draw = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 20000, n))
    for f in range(families):
        body = draw(200)
        for i in range(pairs):
            part, d = draw(12), 2 * (f * pairs + i)
            texts |= {d + j: body + part + draw(20) for j in (0, 1)}
    assert all(lines.similar(texts[d], texts[d + 1]) for d in texts if d % 2 == 0)
    linked = {d: lines.similar(texts[d], texts[(d + 2) % len(texts)]) for d in range(0, len(texts), 2)}
    got = lines.fuzzy_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), limit=limit).toPandas()
    by = dict(zip(got.doc_id, got.keep_doc_id, strict=True))
    assert sum(by[d] == by[d + 1] for d in range(0, len(texts), 2)) >= 0.99 * len(texts) / 2
    if not any(linked.values()):
        assert all(by[d] in (d, d - 1) for d in texts)


def test_sharding_columns(spark):
    docs = table(spark, "documents")
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard(docs).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}


def test_sharding_uniform(spark):
    """Every document is as likely in each shard and in each half of its slots, and pairs are independent."""
    n, rounds = 60, 12
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at, both = Counter(), Counter()
    for seed in range(rounds):
        rows = {r.doc_id: r for r in sharding.shard(docs, shards=3, seed=seed, block_rows=15).collect()}
        at.update((r.shard, r.slot // 10) for r in rows.values())
        both.update(rows[d].shard == rows[d + 1].shard for d in range(0, n, 2))
    expected, same = rounds * n / 6, 19 / 59
    assert sum((at[s, h] - expected) ** 2 / expected for s in range(3) for h in range(2)) < 20.5  # chi square, 5 degrees, 0.999
    assert abs(both[True] - rounds * n / 2 * same) < 3.5 * (rounds * n / 2 * same * (1 - same)) ** 0.5


def brute_log_odds(docs):
    """A function of word and ``own`` (a document that doesn't count): log-odds from the documents that have a
    word's prefix, level by level."""
    held = [({b for w in toxicity.words_of(t) for b in toxicity.features(w)} - {-1}, y) for t, y in docs]
    rate = sum(len(f) for f, y in held if y) / sum(len(f) for f, y in held if not y)

    @lru_cache(None)
    def odds(word, own):
        theta = 0.5
        for bucket in toxicity.features(word):
            if bucket >= 0:
                bad, good = (sum(bucket in f for i, (f, y) in enumerate(held) if y == label and i != own) for label in (1, 0))
                theta = (bad + toxicity.PRIOR * theta) / (bad + good * rate + toxicity.PRIOR)
        return np.log(theta / (1 - theta)) - toxicity.SHIFT

    return odds


def test_toxicity_model(spark):
    """Log-odds, the law's parameters and the score against their definitions."""
    rng = np.random.default_rng(3)
    word = lambda bad: ("vile" if bad and rng.random() < 0.4 else "calm") + str(rng.integers(0, 6))
    docs = [(" ".join(word(i % 3 == 0 and 20 < j < 40) for j in range(60)), int(i % 3 == 0)) for i in range(45)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:45]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, docs, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, docs, strict=True)], "doc_id long, toxic int")
    model, odds = toxicity.train(frame, labels), brute_log_odds(docs)
    for w in ("vile1", "calm5", "unseen", "vileness"):
        got = model.log_odds(np.array([toxicity.features(w)], np.int32))[0]
        assert abs(got - odds(w, None)) < 1e-6
    assert abs(model.log_odds(np.array([toxicity.features("vile1")], np.int32), 1)[0] - odds("vile1", next(i for i, (t, y) in enumerate(docs) if y and "vile1" in t.split()))) < 1e-6
    scores = [[odds(w, i) for w in toxicity.words_of(t)] for i, (t, y) in enumerate(docs) if not y]
    flat = np.concatenate(scores)
    mean = lambda lam: np.exp(lam * flat).mean()
    lo, hi = (model.lam - 0.2, model.lam + 0.2)
    assert (mean(lo) <= 1.02 and mean(hi) >= 0.98) or model.lam in (toxicity._LAMBDAS[0], toxicity._LAMBDAS[-1])
    tops = [max([1.0, *(s for s, _, _ in toxicity.segments(np.array(x)))]) for x in scores]
    k = len(tops) / sum(len(x) * np.exp(-model.lam * t) for x, t in zip(scores, tops, strict=True))
    assert abs(model.k - min(1.0, k)) < 1e-6
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, (t, _) in zip(ids, docs, strict=True):
        x = np.array([odds(w, None) for w in toxicity.words_of(t)])
        floor = np.log(model.k * len(x))
        evidence = sum(max(0.0, model.lam * s - floor) for s, _, _ in toxicity.segments(x) if s >= toxicity.LEAST_SEGMENT)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(evidence))))) < 1e-5


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_awkward(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table go through all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([] if empty else AWKWARD, "doc_id long, text string, lang string, source string")
    for c in ("n_chars", "size", "key", "doc", "score", "kept", "shard", "slot", "c0", "__id", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (8, 1, 1), (8, 0, 0), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "One"), (2, None), (None, "same words here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, now, sf).write.parquet(f"{sf}/{i}")
        now = spark.read.parquet(f"{sf}/{i}")
        assert now.columns == docs.columns
    last = pipeline.STAGES[-1][1](spark, now.drop("shard", "slot"), sf)
    assert last.count() == now.count() and last.columns == [*now.drop("shard", "slot").columns, "shard", "slot"]
    if not empty:
        left = {r.doc_id for r in last.collect()}
        assert 3 in left and not left & {4, 8}
