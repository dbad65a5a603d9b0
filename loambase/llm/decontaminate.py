"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case (A-Z and the
capitals of Latin-1), so that case, punctuation and white space don't matter. Shingles are five
words, or all of them for a shorter item. A window has as many words as the item. A window whose
similarity is ``least`` or more holds as many places of the item's shingles as that share of its
weight, so every window that does, wherever they stand in it, gets a fingerprint (a sliding count over
the places); a document shorter than the item is one window. Each window's
fingerprint is looked up in eight one-byte blocks within two bits of each item's, which finds every
item within ``RADIUS`` bits. What is found is compared on the full multisets: shared weight over
the item's weight, a shingle weighing as often as it occurs.

The benchmark is the query set: it is read in blocks of at most ``block_items`` items and
``block_bytes`` of text, each broadcast once and held against all documents. Null and empty texts
have no words: such items match nothing and such documents have no matches. Items with equal texts
each get their rows; documents that share a doc_id count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, U, chunks, combine, word_hashes

#: Eight blocks within two bits: 8 * (2 + 1) - 1.
RADIUS = 23
WORDS = 5
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False
_NEAR = [[v for v in range(256) if (v ^ w).bit_count() <= 2] for w in range(256)]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z, and U+00C0 to U+00DE but the multiplication sign, in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        tail = data[1:]
        capital = (data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        out[1:][capital] += 32
    return out


def simhash(hashes: np.ndarray) -> np.uint64:
    """Majority of each bit over a multiset of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) >= len(hashes)).view(U)[0]


@dataclass
class Index:
    """Items of one block. shingles: by shingle size, sorted distinct hashes with the kinds (words,
    weight, of items with equal shingles) in which they occur; near: by block of the fingerprint and byte, a bit for each item."""

    ids: np.ndarray
    n_words: np.ndarray
    prints: np.ndarray
    bags: list[tuple[np.ndarray, np.ndarray]]
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    kinds: list[tuple[int, int]]
    near: np.ndarray


def index(items: list[tuple[int, str | None]]) -> Index | None:
    ids, sizes, prints, bags, places, kinds = [], [], [], [], {}, {}
    for item, text in items:
        if not text:
            continue
        data = lowered(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
        words, _ = word_hashes(data, np.array([0, len(data)]), _BREAK)
        if not len(words):
            continue
        k = min(WORDS, len(words))
        runs = combine(words, k)
        ids.append(item)
        sizes.append(len(words))
        prints.append(simhash(runs))
        bags.append(np.unique(runs, return_counts=True))
        kind = (len(words), len(runs), bags[-1][0].tobytes())
        if kind not in kinds:
            kinds[kind] = len(kinds)
            for h in bags[-1][0].tolist():
                places.setdefault(k, {}).setdefault(h, []).append(kinds[kind])
    if not ids:
        return None
    near = np.zeros((8, 256, -(-len(ids) // 8)), np.uint8)
    for i, f in enumerate(prints):
        for b, value in enumerate(np.array([f]).view(np.uint8).tolist()):
            near[b, _NEAR[value], i // 8] |= 128 >> (i % 8)
    tables = {}
    for k, by_hash in places.items():
        keys = np.array(sorted(by_hash), U)
        listed = [by_hash[int(h)] for h in keys]
        tables[k] = (keys, np.cumsum([0, *map(len, listed)]), np.array([i for x in listed for i in x]))
    return Index(np.array(ids, np.int64), np.array(sizes), np.array(prints, U), bags, tables, [x[:2] for x in kinds], near)


def _windows(ix: Index, k: int, runs: np.ndarray, at: np.ndarray, maybe: np.ndarray, least: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Row, words, words there are, and starts of the windows that hold enough of some item's shingles."""
    keys, first, kinds = ix.shingles[k]
    hits = np.flatnonzero(maybe[(runs & U(len(maybe) - 1)).astype(np.int64)])
    where = np.searchsorted(keys, runs[hits])
    good = (where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == runs[hits])
    hits, where = hits[good], where[good]
    rows = np.searchsorted(at, hits, "right") - 1
    inside = hits + k <= at[rows + 1]
    hits, where, rows = hits[inside], where[inside], rows[inside]
    for some in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(rows)) + 1) if len(hits) else ():
        row = int(rows[some[0]])
        lo, hi = int(at[row]), int(at[row + 1])
        places: dict[int, list[int]] = {}
        for pos, w in zip(hits[some].tolist(), where[some].tolist(), strict=True):
            for kind in kinds[first[w] : first[w + 1]].tolist():
                places.setdefault(kind, []).append(pos)
        found: dict[int, list[np.ndarray]] = {}
        for kind, pos in places.items():
            n, weight = ix.kinds[kind]
            if len(pos) >= least * weight - 1e-9:
                there = min(n, hi - lo)
                p = np.array(pos)
                starts = np.arange(max(lo, pos[0] - there + k), min(hi - there, pos[-1]) + 1) if there == n else np.array([lo])
                held = np.searchsorted(p, starts + there - k, "right") - np.searchsorted(p, starts)
                found.setdefault(n, []).append(starts[held >= least * weight - 1e-9])
        for n, starts in found.items():
            starts = np.unique(np.concatenate(starts))
            if len(starts):
                yield row, n, min(n, hi - lo), starts


def _fingerprints(runs: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, np.uint64]]:
    """Each start with the SimHash of the ``size`` runs from it on, from sums over those of near starts."""
    part = max(256, size)
    cuts = np.flatnonzero((np.diff(starts) > size) | (np.diff(starts // part) > 0)) + 1
    for group in np.split(starts, cuts):
        base = int(group[0])
        bits = np.unpackbits(np.ascontiguousarray(runs[base : int(group[-1]) + size]).view(np.uint8).reshape(-1, 8), axis=1)
        total = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
        sums = total[group - base + size] - total[group - base]
        yield from zip(group.tolist(), np.packbits(2 * sums >= size, axis=1).view(U)[:, 0], strict=True)


def _search(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        maybe = {}
        for k, (keys, *_) in ix.shingles.items():
            maybe[k] = np.zeros(1 << 20, bool)
            maybe[k][(keys & U((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            found: list[tuple[int, int, int, int, float]] = []
            ids = batch.column(0).to_pylist()
            for lo, _, data, offsets in chunks(batch.column(1)):
                words, at = word_hashes(lowered(data), offsets, _BREAK)
                for k in ix.shingles:
                    runs = combine(words, k)
                    windows = _windows(ix, k, runs, at, maybe[k], least) if len(runs) else ()
                    for row, n, there, start, f in ((row, n, there, start, f) for row, n, there, starts in windows for start, f in _fingerprints(runs, starts, there - k + 1)):
                        some = ix.near[np.arange(8), np.array([f]).view(np.uint8)]
                        near = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(some, axis=0))[: len(ix.ids)])
                        near = near[(np.bitwise_count(ix.prints[near] ^ f) <= RADIUS) & (ix.n_words[near] == n)]
                        if len(near):
                            values, counts = np.unique(runs[start : start + there - k + 1], return_counts=True)
                        for i in near.tolist():
                            own, weights = ix.bags[i]
                            _, x, y = np.intersect1d(own, values, assume_unique=True, return_indices=True)
                            similarity = np.minimum(weights[x], counts[y]).sum() / weights.sum()
                            found.append((ids[lo + row], int(ix.ids[i]), start - int(at[row]), there, float(similarity)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    part, size = [], 0
    for item, text in benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id").toLocalIterator():
        if part and (len(part) >= block_items or size + len(text or "") > block_bytes):
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text or "")
    if part:
        yield part


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_items: int = 2048, block_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each document and item at their best window
    (the first of equals) where the similarity is ``least`` or more."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    out = spark.createDataFrame([], schema)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for part in blocks(benchmark, block_items, block_bytes):
        ix = index(part)
        if ix is not None:
            out = out.unionByName(texts.mapInArrow(_search(spark.sparkContext.broadcast(ix), least), schema).filter(F.col("similarity") >= least))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("at"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.at")).alias("start_word"), "best.n_words", F.round("best.similarity", 6).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without a match; rows without a doc_id stay."""
    leaks = matches(docs, benchmark, least).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.col("doc_id").cast("long") == F.col("__leak"), "left_anti")
