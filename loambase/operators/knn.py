"""Nearest neighbours of every vector: a self-join of blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 4096
#: Scores are compared at this many decimals, so that rounding doesn't order equal ones.
DECIMALS = 12


def _best(rows: np.ndarray, columns: np.ndarray, score: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row id, column id, score of the k best entries of each row at ``floor`` or more; ties go by column id."""
    least = np.full((len(rows), 1), floor) if score.shape[1] <= k else np.maximum(floor, np.partition(score, -k, axis=1)[:, -k][:, None])
    i, j = np.nonzero((score >= least) & (rows[:, None] != columns[None, :]))
    order = np.lexsort((columns[j], -score[i, j], i))
    i, j = i[order], j[order]
    heads = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    place = np.arange(len(i)) - np.repeat(heads, np.diff(np.append(heads, len(i))))
    i, j = i[place < k], j[place < k]
    return rows[i], columns[j], score[i, j]


def _tile(k: int, floor: float):
    """From a tile (x, y, part, doc, unit) of two blocks, or one with itself: the best of each block's vectors in the other."""

    def run(table: pa.Table) -> pa.Table:
        doc, part = table.column("doc").to_numpy(), table.column("part").to_numpy()
        units = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        sides = [(part == x, part == y)] if x == y else [(part == x, part == y), (part == y, part == x)]
        out = []
        for mine, other in sides:
            rows, columns = np.flatnonzero(mine), np.flatnonzero(other)
            for lo in range(0, len(rows), 512):
                at = rows[lo : lo + 512]
                score = np.round(np.clip(units[at] @ units[columns].T, 0, 1), DECIMALS)
                # A vector is no neighbour of itself, and may take a place of its row's best.
                out.append(_best(doc[at], doc[columns], score, k + 1, floor))
        query, near, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(query), "doc": pa.array(near), "score": pa.array(score)})

    return run


def unit(vector: str):
    """A vector at length one; zero stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def neighbours(corpus: DataFrame, k: int = 5, floor: float = 0.6, block: int = BLOCK) -> DataFrame:
    """(query, doc, score, rank): for every row of corpus (doc, vector) its k nearest others by cosine, at ``floor`` or
    more; ties go by doc. Docs are distinct; rows without a doc or a vector have none.

    Rows are dealt to blocks by a hash. A task holds two blocks and gives at most k + 1 rows for each of their
    vectors, whatever their number of neighbours; the best of a vector's tiles are merged."""
    rows = corpus.filter("doc is not null and vector is not null").select(F.col("doc").cast("long").alias("doc"), unit("vector").alias("unit"))
    parts = max(1, -(-rows.count() // block))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    tiles = tiles.select(F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc", "unit")
    found = tiles.groupBy("x", "y").applyInArrow(_tile(k, floor), "query long, doc long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
