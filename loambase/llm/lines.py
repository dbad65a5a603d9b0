"""Fuzzy line deduplication: character-shingle MinHash, banding, exact Jaccard, union-find.

A line is a piece between line feeds, without a carriage return at its end. Its set holds its runs
of eight characters; a shorter line is its own only shingle. Lines whose sets have a Jaccard
similarity of 0.8 or more are linked; of the lines that links connect, the first (smallest doc_id,
then line number) stays. Lines of white space only are never linked and all stay.

Equal lines are one node. Signatures are eight bands of three minima: a link at 0.8 shares a bucket
with probability 0.997, at 0.9 with 0.99997. Lines are compared with the bucket's first, and then in
rounds on the buckets that hold several components (see ``rounds``), so no bucket is given up. Null text
has one empty line. Rows that share a doc_id are taken as parts of one document, whose equal (doc_id,
line number) pairs stay or go together; rows without a doc_id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import key_filter, passing
from .rounds import LIMIT, Likeness, linked, shared
from .store import materialize, small_batches
from .text import U, mix, prefix_hash_of, run_hashes, span_hash

SHINGLE, BANDS, ROWS = 8, 8, 3
#: Random values of the characters of the basic plane.
_POINT = mix(np.arange(1 << 16, dtype=U))


def _orders(n: int, seed: int = 0) -> list[tuple[np.uint32, np.uint32]]:
    """Multiplier and mask of each of n orders of shingles."""
    multipliers = (mix(np.arange(seed, seed + n, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
    return list(zip(multipliers, (mix(np.arange(seed + 5000, seed + 5000 + n, dtype=U)) >> U(32)).astype(np.uint32), strict=True))


_ORDERS = _orders(BANDS * ROWS)
#: Columns of a line's band keys, and of its minima in eight bits.
_BANDS, _SKETCH = [f"band{i}" for i in range(BANDS)], [f"sketch{i}" for i in range(BANDS * ROWS // 8)]


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def lines_of(text: str | None) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in (text or "").split("\n")]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each of these non-empty lines, one line after the other, and where each begins."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    values = _POINT[points] if points.max(initial=0) < len(_POINT) else mix(points)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    runs = np.append(run_hashes(values, SHINGLE), np.zeros(min(SHINGLE - 1, len(values)), U))
    # No run begins at a line's last places, but for the one of a shorter line.
    begins = np.ones(len(values), bool)
    for i in range(1, SHINGLE):
        begins[np.maximum(ends - i, 0)] = False
    short = sizes < SHINGLE
    if short.any():
        to = np.cumsum(sizes[short])
        at = (ends - sizes)[short]
        runs[at] = span_hash(prefix_hash_of(values[np.repeat(short, sizes)]), to - sizes[short], to)
        begins[at] = True
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    return runs[begins], np.cumsum(counts) - counts


def signatures(lines: list[str], orders: list[tuple[np.uint32, np.uint32]] = _ORDERS, n: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A row of band keys (of ``n`` minima each) and one of minima for each of these non-empty lines."""
    minima = np.empty((len(orders), len(lines)), np.uint32)
    for lo, hi in _blocks(lines):
        hashes, first = shingle_hashes(lines[lo:hi])
        hashes = (hashes >> U(32)).astype(np.uint32)
        at = np.empty_like(hashes)
        for (m, s), least in zip(orders, minima, strict=True):
            np.multiply(np.bitwise_xor(hashes, s, out=at), m, out=at)
            np.minimum.reduceat(at, first, out=least[lo:hi])
    keys = np.zeros((len(orders) // n, len(lines)), U)
    for i, least in enumerate(minima):
        keys[i // n] = mix(keys[i // n] ^ least)
    return np.ascontiguousarray(mix(keys ^ mix(np.arange(len(keys), dtype=U))[:, None]).T).view(np.int64), np.ascontiguousarray(minima.T)


def _blocks(lines: list[str], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Bounds of runs of lines of about ``most`` characters, whose hashes stay in a core's cache."""
    lo, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if size > most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(lines):
        yield lo, len(lines)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the minima that agree (in eight bits), by row."""
    return (x.view(np.uint8) == y.view(np.uint8)).mean(axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        bands, minima = signatures([x[2] for x in rows])
        sketch = np.ascontiguousarray(minima >> np.uint32(16)).astype(np.uint8).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([digest(x[2]) for x in rows], pa.binary()), pa.array([max(1, len(x[2]) - SHINGLE + 1) for x in rows], pa.int64()), *map(pa.array, (*bands.T, *sketch.T))], ["doc_id", "line_no", "key", "size", *_BANDS, *_SKETCH])

    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for n, line in enumerate(lines_of(text.as_py())):
                if line and not line.isspace():
                    rows.append((doc, n, line))
                    size += len(line)
                    if size > 1 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, numbers, keys = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for n, line in enumerate(lines_of(text.as_py())):
                docs.append(doc)
                numbers.append(n)
                # Lines that no other equals have a key that is no digest.
                keys.append(digest(line) if line and not line.isspace() else b"%d:%d" % (doc, n))
            if len(docs) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "line_no", "key"])
                docs, numbers, keys = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "line_no", "key"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, line; a task gives each line once as long as it remembers it."""
    seen: set[bytes] = set()
    for batch in batches:
        keys, texts, size = [], [], 0
        for text in batch.column(1):
            for line in lines_of(text.as_py()):
                if line and not line.isspace() and (key := digest(line)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    texts.append(line)
                    size += len(line)
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "line"])
                keys, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["key", "line"])


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: str, b: str, percent: int = 80) -> bool:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 256):
                sides = []
                for part in (batch.column(i).slice(at, 256).to_pylist() for i in (2, 3)):
                    hashes, first = shingle_hashes(part)
                    sides.append([distinct(x) for x in np.split(hashes, first[1:])])
                for n, (x, y) in enumerate(zip(*sides, strict=True)):
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                        both = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                        keep[at + n] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return run


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


def _elements(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = shingle_hashes(table.column(3).to_pylist())
    return hashes, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))


def fuzzy_lines(docs: DataFrame, percent: int = 80, limit: int = LIMIT) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept: one row per line."""
    small_batches(docs.sparkSession)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Equal lines of one task meet before the shuffle; size and bands follow from the line, so any will do.
    # Places are one number each while they are compared, so that rows are grouped by hash, not by a sort.
    at, place = F.struct("doc_id", "line_no"), F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32) + F.col("line_no")
    first = F.struct(F.expr("(place - pmod(place, 4294967296)) div 4294967296").alias("doc_id"), F.expr("cast(pmod(place, 4294967296) as long)").alias("line_no"))
    told = ["size", *_BANDS, *_SKETCH]
    signed = texts.mapInArrow(_signed, "doc_id long, line_no long, key binary, " + ", ".join(f"{c} long" for c in told))
    grouped = signed.withColumn("place", place.cast("decimal(38,0)")).groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in told))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "lines")
    rows = shared(nodes.select(F.posexplode(F.array(*_BANDS)).alias("at", "key"), "node", "size"))
    # Most lines share no bucket: the rounds never look at them again. The others' texts are fetched once.
    held = materialize(nodes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "key", first.alias("first"), "size", F.array(*_SKETCH).alias("sketch")), "held_lines")
    there = passing(texts.mapInArrow(_asked, "key binary, line string"), "key", key_filter(held, "key"))
    found = materialize(held.select("node", "key").join(there, "key").groupBy("node").agg(F.any_value("line").alias("item")), "line_texts")

    def items(asked: DataFrame) -> DataFrame:
        """The items of these nodes, and of some others."""
        return passing(found, "node", key_filter(asked, "node"))

    def confirm(pairs: DataFrame) -> DataFrame:
        sides = items(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        return pairs.join(sides.toDF("a", "la"), "a").join(sides.toDF("b", "lb"), "b").select("a", "b", "la", "lb").mapInArrow(_confirm(percent), "a long, b long")

    joined = linked(held, rows, Likeness(_agreeing, BANDS * ROWS, percent, sizes=False), confirm, items, _elements, limit)
    placed = materialize(joined.join(held.select("node", "key", "first"), "node").select("component", "key", "first"), "linked_lines")
    best = materialize(placed.groupBy("component").agg(F.min("first").alias("best")), "best_lines")
    # A line that occurs once and has no link keeps itself: only the others are looked up.
    several = nodes.filter("n > 1").select("key", first.alias("best")).join(placed.select("key"), "key", "left_anti")
    decided = materialize(placed.join(best, "component").select("key", "best").unionByName(several), "decided_lines")
    rows = texts.mapInArrow(_keys, "doc_id long, line_no long, key binary")
    joined = rows.join(decided, "key", "left").withColumn("best", F.coalesce("best", at))
    return joined.select("doc_id", "line_no", F.col("best.doc_id").alias("keep_doc_id"), F.col("best.line_no").alias("keep_line_no"), (F.col("best") == at).alias("kept"))


def cleaned(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, text with the lines that don't stay left out."""
    gone = decisions.filter("not kept").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    pieces = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    kept = F.filter(pieces, lambda x, i: ~F.coalesce(F.array_contains("__gone", i.cast("long")), F.lit(False)))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left").select("doc_id", F.array_join(kept, "\n").alias("text"))
