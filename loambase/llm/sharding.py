"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Documents lie in blocks by a hash of themselves. How many documents of each block go to each shard
is drawn from the multivariate hypergeometric law, so that all shards get their exact sizes and
every division is as likely as under a full shuffle. Each block is permuted locally (by a second
hash) and cut at the drawn counts; the documents are exchanged; each shard is permuted again, in
runs of about ``block_rows`` whose counts are added up, so that no task holds a shard.

Everything follows from the rows and the seed: a lost task is repeated with the same result. Rows
that agree in doc_id, size and text fingerprint are interchangeable. Null text has 1 as its size and
0 as its fingerprint. An empty table gives no rows.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _uniform(bits: Column, n: Column) -> Column:
    """One of n equal parts of the range of a 64-bit hash."""
    return F.least(F.floor((bits / (2.0**64) + 0.5) * n).cast("long"), n.cast("long") - 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` are good: inversion from the mode outwards. numpy's own stops at 1e9; here the
    chances' relative error is some 1e-5 for 1e10 rows."""
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    up = down = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left, above, below = rng.random() - up, mode, mode
    while left > 0:
        if above >= hi and below <= lo:
            return mode
        if above < hi:
            up *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            left -= up
            if left <= 0:
                return above
        if below > lo:
            down *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            left -= down
            if left <= 0:
                return below
    return mode


def matrix(sizes: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by block and shard: rows sum to the blocks' sizes, columns differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(sizes.sum())
    left = [total // shards] * shards
    for j in rng.permutation(shards)[: total % shards]:
        left[j] += 1
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, size in enumerate(sizes):
        draws, rest = int(size), sum(left)
        for j in range(shards):
            rest -= left[j]
            out[i, j] = hypergeometric(rng, left[j], rest, draws)
            draws -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 29, block_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. The driver holds one count per block and, drawn from
    it, one per block and shard: ``rows / block_rows`` blocks, or ``MOST_BLOCKS`` if that is less."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    keyed = rows.withColumn("first", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed))).withColumn("second", F.xxhash64("text_crc32", "size", "doc_id", F.lit(seed + 1))).withColumn("third", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed + 2)))
    blocks = F.lit(max(1, min(MOST_BLOCKS, -(-docs.count() // block_rows))))
    placed = keyed.withColumn("block", _uniform(F.col("first"), blocks))
    counts = sorted((r["block"], r["count"]) for r in placed.groupBy("block").count().collect())
    drawn = matrix(np.array([n for _, n in counts], dtype=np.int64), shards, seed)
    bounds = [(int(b), [int(x) for x in np.cumsum(row)]) for (b, _), row in zip(counts, drawn, strict=True)]
    cuts = spark.createDataFrame(bounds, T.StructType([T.StructField("block", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("second", "doc_id", "text_crc32", "size")))
    sent = ranked.join(F.broadcast(cuts), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    runs = F.greatest(F.lit(1), F.ceil(blocks / shards))
    exchanged = sent.withColumn("run", _uniform(F.col("third"), runs)).select("doc_id", "size", "text_crc32", "shard", "run", "third")
    sums = exchanged.groupBy("shard", "run").count()
    starts = sums.select("shard", "run", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("third", "doc_id", "text_crc32", "size")) - 1
    return exchanged.withColumn("inside", inside).join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("start") + F.col("inside")).cast("long").alias("slot"))


def placed(docs: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """All columns of ``docs`` with shard and slot. Rows that agree in doc_id and text are numbered by a hash of
    their other columns (but maps and variants), and each takes one of their places; texts move once, to
    their rows' places."""
    others = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant")) and f.name != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("crc"), F.xxhash64(*others).alias("rest"))
    nth = lambda *order: F.row_number().over(Window.partitionBy("id", "crc").orderBy(*order)).alias("n")
    numbered = keyed.select("row", "id", "crc", nth("rest"))
    places = shard(docs, shards, seed).select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), "shard", "slot").select("id", "crc", "shard", "slot", nth("shard", "slot"))
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.crc") == F.col("p.crc")) & (F.col("d.n") == F.col("p.n"))
    return numbered.alias("d").join(places.alias("p"), same).select("d.row.*", "p.shard", "p.slot")


#: Blocks whose counts the driver holds at most (8 shards: some 100 MB); beyond, blocks grow.
MOST_BLOCKS = 100_000
