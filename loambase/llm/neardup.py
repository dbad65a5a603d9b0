"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges in rounds, exact confirmation, distributed union-find.

A document's set holds its distinct runs of ``words`` words (of ``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); with fewer words the whole sequence is its one element; without words it is empty
and linked with nothing. Null text counts as empty. Equal sets form a class without any pair
being made; one representative of each class goes on. Rows that share a doc_id count as one
document with several texts; rows without a doc_id are left out. Only ``doc_id`` and ``text`` are
read, so further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import flagged, key_filter, passing
from .rounds import LIMIT, Likeness, linked, shared
from .store import materialize, small_batches
from .text import U, chunks, combine, mix, shingle_sets

#: Bands of ROWS bins; the rest of the BINS serves the sketch alone.
BINS, BANDS, ROWS = 128, 25, 5
_SIGNATURE = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>"


def _probes() -> np.ndarray:
    """For each bin, the order in which it looks for a bin to borrow from: one permutation each,
    so that a search always ends."""
    keys = mix(np.arange(BINS * BINS, dtype=U) + U(0x51ED2701)).reshape(BINS, BINS)
    return np.argsort(keys, axis=1, kind="stable")


_PROBES = _probes()
_BOUNDS = np.arange(BINS, dtype=U) << U(64 - 7)


def densified(values: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set: the least value of each bin; an empty
    bin borrows from the first filled bin of its own probe order."""
    at = np.searchsorted(values, _BOUNDS)
    end = np.append(at[1:], len(values))
    filled = at < end
    out = values[np.minimum(at, len(values) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = _PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return out


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_no = mix(np.arange(BANDS, dtype=U))
        nibble = U(4) * np.arange(16, dtype=U)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sizes, ids, bands, sketches = [], [], [], []
                for values in shingle_sets(data, offsets, words):
                    sizes.append(len(values))
                    ids.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                    if len(values):
                        s = densified(values)
                        bands.append(mix(combine_rows(banded(s)) ^ band_no).view(np.int64))
                        sketches.append((((s >> U(20)) & U(15)).reshape(8, 16) << nibble).sum(axis=1, dtype=U).view(np.int64))
                    else:
                        bands.append(None)
                        sketches.append(None)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)],
                    ["doc_id", "n_shingles", "set_id", "bands", "sketch"],
                )

    return run


def banded(signature: np.ndarray) -> np.ndarray:
    return signature[: BANDS * ROWS].reshape(BANDS, ROWS)


def combine_rows(values: np.ndarray) -> np.ndarray:
    """One hash of each row of a matrix."""
    out = np.zeros(len(values), U)
    for j in range(values.shape[1]):
        out = mix(out ^ values[:, j])
    return out


def signatures(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set; null if empty), band keys, 4-bit sketch."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures(words), _SIGNATURE)


def texts_of(docs: DataFrame, name: str) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias(name), F.col("text").cast("string").alias("text"))


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the sketch bins that agree, by row, freed of those that agree by chance."""
    d = x ^ y
    d |= d >> U(1)
    d |= d >> U(2)
    d &= U(0x1111111111111111)
    return (1 - np.bitwise_count(d).sum(axis=1) / BINS - 1 / 16) / (15 / 16)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in shingle_sets(data, offsets, words)], pa.binary())], ["node", "item"])

    return run


def _elements(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    items = [np.frombuffer(x, U) for x in table.column(3).to_pylist()]
    return np.concatenate(items), np.repeat(np.arange(len(items)), [len(x) for x in items])


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offsets in chunks(batch.column(2), 1 << 20):
                left = list(shingle_sets(data, offsets, words))
                n = 0
                for l2, h2, data2, offsets2 in chunks(batch.column(3).slice(lo, hi - lo), 1 << 20):
                    for right in shingle_sets(data2, offsets2, words):
                        one = left[n]
                        both = len(np.intersect1d(one, right, assume_unique=True)) if 100 * min(len(one), len(right)) >= percent * max(len(one), len(right)) else 0
                        keep[lo + n] = both > 0 and 100 * both >= percent * (len(one) + len(right) - both)
                        n += 1
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return run


def confirmed(docs: DataFrame, edges: DataFrame, words: int, percent: int = 80) -> DataFrame:
    """Edges (a table) with 100 * intersection >= percent * union on the documents' full sets. Texts of documents
    without a candidate stay where they are; one exchange of the others serves both ends of the pairs."""
    asked = edges.select(F.explode(F.array("a", "b")).alias("doc"))
    texts = passing(texts_of(docs, "doc"), "doc", key_filter(asked, "doc"))
    one, two = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return edges.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(words, percent), "a long, b long").distinct()


def classes(signed: DataFrame) -> DataFrame:
    """``signed`` with ``doc``, the smallest doc_id with an equal set. Only rows whose set may occur again are
    looked up; a class's size is counted before the shuffle."""
    again = materialize(signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")).filter("n > 1").select("set_id", "doc"), "copies")
    told = flagged(signed, "set_id", key_filter(again, "set_id"), "maybe").withColumn("maybe", F.col("maybe") & F.col("set_id").isNotNull())
    looked = told.filter("maybe").join(again, "set_id", "left").withColumn("doc", F.coalesce("doc", "doc_id"))
    return told.filter("not maybe").withColumn("doc", F.col("doc_id")).unionByName(looked)


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Candidates come from 25 bands of 5 bins: a pair at 0.8 shares none with probability 5e-5. First each
    member of a bucket is compared with the bucket's smallest document. Buckets that then still hold
    several components are searched by sketches within a task; pairs that these leave open are compared
    on full sets, where there are many of them within the bucket's task. Buckets of over ``limit``
    members are searched in tiles (see ``rounds``)."""
    small_batches(docs.sparkSession)
    signed = materialize(signatures(docs, words), "signatures")
    placed = materialize(classes(signed), "classes")
    # A set that occurs once has one row; of a class, rows that share the smallest doc_id are alike.
    first = placed.filter("set_id is not null and doc_id = doc").select(F.col("doc").alias("node"), F.col("n_shingles").alias("size"), "bands", "sketch", "maybe", "set_id")
    reps = materialize(first.filter("not maybe").unionByName(first.filter("maybe").dropDuplicates(["node", "set_id"])).drop("maybe", "set_id"), "representatives")
    rows = reps.select(F.posexplode("bands").alias("at", "key"), "node", "size")
    items = lambda nodes: passing(texts_of(docs, "node"), "node", key_filter(nodes, "node")).mapInArrow(_sets(words), "node long, item binary")
    found = linked(reps, shared(rows), Likeness(_agreeing, BINS, percent), lambda edges: confirmed(docs, edges, words, percent), items, _elements, limit)
    out = placed.select("doc_id", "n_shingles", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
