"""Removal of repeated 100-byte strings with suffix arrays built by two-stage sorting.

A window is a string of 100 bytes within a document; all windows that equal an earlier one (smaller
doc_id, or the same document and an earlier start) have their bytes removed.

1. Every window is assigned to the least hash of the 24-byte strings in it, so that equal windows
   share it. Consecutive windows with one hash are a range (about 40 windows). The hash is but a route:
   it brings ranges together, and whatever is removed has been compared byte by byte. Copies within a
   batch are settled before the shuffle, so that a passage in a third of all documents sends one row
   per batch.
2. Where one hash has several ranges, or one that may repeat itself, their bytes are fetched (about 140
   each). Equal ones of a task become one. The suffixes of all are then sorted in batches: suffixes
   smaller than their successors directly, by eight bytes at a time among those still tied; the rest by
   scanning the buckets of first bytes in order, each placed by its successor's rank. Neighbours with a
   common prefix of 100 bytes are equal windows.
3. A route with more than ``MOST_RANGES`` ranges isn't sorted in one task: its windows are sent by a
   further prefix of theirs (32, 64, 100 bytes, as long as a part is too large) and sorted there.

Null text is empty. Null doc_ids count as the smallest. Rows that share a doc_id are one document, of
which a window counts once for each position; each row is cut by what any of them has repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import flagged, key_filter, passing
from .store import materialize, small_batches
from .text import U, _power, _BASE, chunks, mix, prefix_hash, span_hash

WINDOW, GRAM = 100, 24
#: Windows of a range at most; only runs of repeated content reach it. Ranges of a route that are sorted in one task.
MOST_WINDOWS, MOST_RANGES = 256, 4000
_NO_ID = -(1 << 63)
_RUNS = "doc long, start long, n int"


def window_minima(data: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window, the least hash of the GRAM-byte strings in it, and whether it is
    that of the first of them and of another one, too."""
    n = len(data) - GRAM + 1
    hashes = mix((prefix[GRAM:] - prefix[:n]) * _power("up", _BASE, n))
    least, width, wanted = hashes[1:], 1, WINDOW - GRAM
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    later = np.minimum(least[: len(least) - rest], least[rest:])
    first = hashes[: len(later)]
    return np.minimum(first, later), first == later


def ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start (in the chunk), windows, hash, content fingerprint of every range, and whether some of
    its own windows may be equal (their hash then stands twice: in one of them, once at its start, or
    as far apart as windows that follow each other with one of the two in each, which makes the range
    longer than one place of a hash can)."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2 + (np.zeros(0, bool),)
    if len(data) < WINDOW:
        return none
    prefix = prefix_hash(data)
    least, twice = window_minima(data, prefix)
    sizes = np.diff(offsets)
    valid = np.zeros(len(least) + 1, np.int8)
    rows = np.flatnonzero(sizes >= WINDOW)
    if not len(rows):
        return none
    firsts, lasts = offsets[rows], offsets[rows + 1] - WINDOW + 1
    valid[firsts] += 1
    np.subtract.at(valid, lasts, 1)
    inside = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[firsts] = True
    starts = np.flatnonzero(new & inside)
    row = np.searchsorted(offsets, starts, "right") - 1
    stops = np.minimum(np.append(starts[1:], len(least)), offsets[row + 1] - WINDOW + 1)
    parts = -(-(stops - starts) // MOST_WINDOWS)
    if (parts > 1).any():
        at = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stops, row = starts[at] + k * MOST_WINDOWS, stops[at], row[at]
        stops = np.minimum(stops, starts + MOST_WINDOWS)
    n = stops - starts
    count = np.concatenate([[0], np.cumsum(twice)])
    return row, starts, n, least[starts], span_hash(prefix, starts, stops + WINDOW - 1), (count[stops] > count[starts]) | (n > WINDOW - GRAM + 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (route, doc, place): place is start * 2048 + windows * 4, plus 2 if its own windows may
    be equal, plus 1 if it is a copy of an earlier range of its batch; those go anywhere."""
    for batch in batches:
        docs = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        bodies: list[bytes] = []
        for lo, _, data, offsets in chunks(batch.column(1)):
            row, start, n, h, c, own = ranges(data, offsets)
            parts.append((docs[lo + row], start - offsets[row], n, h, c, own, np.full(len(row), len(bodies)), start))
            bodies.append(data.tobytes())
        if not parts:
            continue
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((columns[1], columns[0], columns[4], columns[3]))
        doc, start, n, h, c, own, body, at = (x[order] for x in columns)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else same
        again = same & (doc == doc[first]) & (start == start[first])
        for i in np.flatnonzero(same & ~again).tolist():
            f, size = first[i], n[i] + WINDOW - 1
            same[i] = bodies[body[i]][at[i] : at[i] + size] == bodies[body[f]][at[f] : at[f] + size]
        keep = ~again
        route = np.where(same, mix(doc.astype(U) + c), h).view(np.int64)[keep]
        doc, place = doc[keep], (start * 2048 + n * 4 + own * 2 + same)[keep]
        for lo in range(0, len(route), 200_000):
            part = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(route[part]), pa.array(doc[part]), pa.array(place[part])], ["route", "doc", "place"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of route, doc and place: removed ranges (route null), and all ranges of routes with
    several or with one that may have equal windows of its own."""
    held = None  # route, doc, place of the last range, and whether it is known to be sent

    def rows(doc: np.ndarray, place: np.ndarray, route: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place >> 11), pa.array(((place & 2047) >> 2).astype(np.int32)), pa.nulls(len(doc), pa.int64()) if route is None else pa.array(route)], ["doc", "start", "n", "route"])

    for batch in batches:
        route, doc, place = (batch.column(i).to_numpy() for i in range(3))
        copy = (place & 1) == 1
        if copy.any():
            yield rows(doc[copy], place[copy], None)
        route, doc, place = route[~copy], doc[~copy], place[~copy]
        if not len(route):
            continue
        if held is not None:
            route, doc, place = (np.append(h, x) for h, x in zip(held[:3], (route, doc, place), strict=True))
        again = (route[1:] == route[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        once = np.append(True, ~again)
        route, doc, place = route[once], doc[once], place[once]
        same = route[1:] == route[:-1]
        send = ((place & 2) == 2) | np.append(False, same) | np.append(same, False)
        if held is not None:
            send[0] |= held[3]
        yield rows(doc[:-1][send[:-1]], place[:-1][send[:-1]], route[:-1][send[:-1]])
        held = (route[-1], doc[-1], place[-1], bool(send[-1]))
    if held is not None and held[3]:
        yield rows(np.array([held[1]]), np.array([held[2]]), np.array([held[0]]))


def two_stage_order(data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Positions of all windows, in order of their first 100 bytes. Strings of ``windows + 99`` bytes
    begin at ``starts`` and lie one after the other in ``data``."""
    n, stops = len(data), starts + windows + WINDOW - 1
    end = np.zeros(n, bool)
    end[stops - 1] = True
    # Direction to the successor: smaller than it (S) or not; the last suffix of a string is not.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[end] = -1
    told = np.where(step != 0, np.arange(n), n)
    told = np.minimum.accumulate(told[::-1])[::-1]
    smaller = step[told] > 0
    # Wanted: windows, and after the last window what its order is induced from.
    next_s = np.where(smaller, np.arange(n), n)
    next_s = np.append(np.minimum.accumulate(next_s[::-1])[::-1], n)
    until = np.minimum(next_s[starts + windows] + 1, stops)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, until, 1)
    wanted = np.cumsum(mark[:-1]) > 0
    padded = np.concatenate([data, np.zeros(WINDOW + 16, np.uint8)])
    words = np.zeros(len(padded) - 7, U)
    for j in range(8):
        words = (words << U(8)) | padded[j : len(padded) - 7 + j]
    # Directly sorted: eight bytes at a time, those still tied.
    s = np.flatnonzero(wanted & smaller)
    s = s[np.argsort(words[s], kind="stable")]
    new = np.ones(len(s), bool)
    new[1:] = words[s[1:]] != words[s[:-1]]
    for depth in range(8, WINDOW + 4, 8):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(group) else group
        if not len(tied):
            break
        sub, g = s[tied], group[tied]
        w = words[sub + depth]
        o = np.lexsort((w, g))
        s[tied], w = sub[o], w[o]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        new[tied] = fresh
    # Induced: bucket by bucket of the first byte; first what is followed by a smaller byte or the
    # end, by the successor's rank, then what is followed by the same byte, one step at a time.
    rank = np.full(n + 1, -1, np.int64)
    s_first = data[s]
    larger = np.flatnonzero(wanted & ~smaller)
    follows = np.where(end[larger], -1, data[np.minimum(larger + 1, n - 1)].astype(np.int16))
    same_next = follows == data[larger]
    by_byte = np.argsort(data[larger], kind="stable")
    bounds, s_bounds = np.searchsorted(data[larger][by_byte], np.arange(257)), np.searchsorted(s_first, np.arange(257))
    out, count = [], 0
    for byte in range(256):
        mine = by_byte[bounds[byte] : bounds[byte + 1]]
        layer = larger[mine[~same_next[mine]]]
        again = larger[mine[same_next[mine]]]
        if len(layer):
            layer = layer[np.argsort(np.where(end[layer], -1, rank[np.minimum(layer + 1, n)]), kind="stable")]
        waiting = np.zeros(0, bool)
        if len(again):
            waiting = np.zeros(n + 1, bool)
            waiting[again] = True
        while len(layer):
            rank[layer] = count + np.arange(len(layer))
            count += len(layer)
            out.append(layer)
            if not len(waiting):
                break
            before = layer[layer > 0] - 1
            layer = before[waiting[before]]
        direct = s[s_bounds[byte] : s_bounds[byte + 1]]
        rank[direct] = count + np.arange(len(direct))
        count += len(direct)
        out.append(direct)
    order = np.concatenate(out) if out else s
    is_window = np.zeros(n + 1, np.int32)
    np.add.at(is_window, starts, 1)
    np.subtract.at(is_window, starts + windows, 1)
    return order[np.cumsum(is_window)[order] > 0]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position but the first, whether it and the one before share 100 bytes."""
    padded = np.concatenate([data, np.zeros(WINDOW + 16, np.uint8)])
    quads = np.zeros(len(padded) - 3, np.uint32)
    for j in range(4):
        quads = (quads << np.uint32(8)) | padded[j : len(padded) - 3 + j]
    alive = np.arange(1, len(order))
    for depth in range(0, WINDOW, 4):
        alive = alive[quads[order[alive] + depth] == quads[order[alive - 1] + depth]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alive - 1] = True
    return out


def repeated_windows(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, start, windows) of the windows that equal an earlier one of these ranges."""
    at = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
    order = two_stage_order(data, at, windows)
    of = np.searchsorted(at, order, "right") - 1
    d, p = doc[of], start[of] + order - at[of]
    group = np.concatenate([[0], np.cumsum(~common_prefixes(data, order))])[: len(order)]
    o = np.lexsort((p, d, group))
    d, p, group = d[o], p[o], group[o]
    first = np.ones(len(o), bool)
    first[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    gone = (d != d[lead]) | (p != p[lead])
    return as_runs(d[gone], p[gone])


def as_runs(d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((p, d))
    d, p = d[o], p[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(d))[: len(heads)] - 1
    return d[heads], p[heads], p[tails] - p[heads] + 1


class _Combined:
    """Ranges of one task by route and bytes: of equal ones the first stays, the others are removed."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.gone: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, route: int, doc: int, start: int, block: bytes) -> None:
        here = self.first.setdefault((route, block), (doc, start))
        if here == (doc, start):
            self.size += len(block) + 200
            return
        if (doc, start) < here:
            self.first[route, block] = doc, start
            doc, start = here
        self.gone.append((doc, start, len(block) - WINDOW + 1))

    def rows(self, every: bool) -> Iterator[pa.RecordBatch]:
        """What has come together, if it is much or all: rows (route, doc, start, n, block), removed ones without route and block."""
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = ["route", "doc", "start", "n", "block"]
        if self.gone and (every or len(self.gone) > 50_000):
            doc, start, n = zip(*self.gone, strict=True)
            none = [None] * len(doc)
            self.gone = []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, doc, start, n, none), kinds, strict=True)], names)
        if every or self.size > 48 << 20:
            held, self.first, self.size = list(self.first.items()), {}, 0
            for at in range(0, len(held), 20_000):
                part = held[at : at + 20_000]
                columns = [k[0] for k, _ in part], [v[0] for _, v in part], [v[1] for _, v in part], [len(k[1]) - WINDOW + 1 for k, _ in part], [k[1] for k, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted ranges (doc, text, wanted)."""
    found = _Combined()
    for batch in batches:
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            body = (text.as_py() or "").encode()
            w = wanted.values
            for route, start, n in zip(w.field("route").to_pylist(), w.field("start").to_pylist(), w.field("n").to_pylist(), strict=True):
                block = body[start : start + n + WINDOW - 1]
                if len(block) == n + WINDOW - 1:
                    found.add(route, doc, start, block)
            yield from found.rows(False)
    yield from found.rows(True)


def _by_prefix(size: int):
    """The windows of ranges (route, doc, start, n, block) as ranges of their own, by their first ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Combined()
        for batch in batches:
            for route, doc, start, n, block in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for i in range(n):
                    digest = hashlib.blake2b(block[i : i + size], digest_size=8, salt=route.to_bytes(8, "little", signed=True)).digest()
                    found.add(int.from_bytes(digest, "little", signed=True), doc, start + i, block[i : i + WINDOW])
                yield from found.rows(False)
        yield from found.rows(True)

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of rows in order of route, about 1 MB at a time and never within a route."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        blocks = table["block"].combine_chunks().cast(pa.large_binary())
        if isinstance(blocks, pa.ChunkedArray):
            blocks = blocks.combine_chunks()
        bounds = np.frombuffer(blocks.buffers()[1], np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
        data = np.frombuffer(blocks.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        d, p, n = repeated_windows(table["doc"].to_numpy(), table["start"].to_numpy(), table["n"].to_numpy().astype(np.int64), data)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(n.astype(np.int32))], ["doc", "start", "n"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 2000)
            at += part.num_rows
            if size > 1 << 20:
                # The rows of the route that is being read stay with what follows.
                route = held[-1].column(0)[len(held[-1]) - 1].as_py()
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                routes = whole.column(0).to_numpy()
                cut = int(np.flatnonzero(routes != route)[-1]) + 1 if (routes != route).any() else 0
                if cut:
                    yield solve([whole.slice(0, cut)])
                    held = [whole.slice(cut)]
                    size = held[0].column(4).nbytes
            held.append(part)
            size += part.column(4).nbytes
    if held and sum(map(len, held)):
        yield solve(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, spans, digests = [], [], [], []
        for text, runs in zip(batch.column(1), batch.column(2), strict=True):
            body = (text.as_py() or "").encode()
            kept, at, removed, count = [], 0, 0, 0
            if runs.is_valid:
                r = runs.values
                s = np.asarray(r.field("start").to_numpy(zero_copy_only=False), np.int64)
                e = np.minimum(s + r.field("n").to_numpy(zero_copy_only=False) + WINDOW - 1, len(body))
                o = np.argsort(s, kind="stable")
                s, e = s[o], np.maximum.accumulate(e[o]) if len(o) else e
                heads = np.flatnonzero(np.append(True, s[1:] > e[:-1])) if len(s) else []
                for i, j in zip(heads, np.append(heads[1:], len(s)), strict=True) if len(s) else ():
                    lo, hi = int(s[i]), int(e[j - 1])
                    if lo >= hi:
                        continue
                    kept.append(body[at:lo])
                    at, removed, count = hi, removed + hi - lo, count + 1
            kept.append(body[at:])
            sizes.append(len(body))
            gone.append(removed)
            spans.append(count)
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc, start, n: runs of window starts that repeat earlier windows. They may overlap."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    scanned = texts.mapInArrow(_scan, "route long, doc long, place long")
    settled = scanned.repartition("route").sortWithinPartitions("route", "doc", "place").mapInArrow(_settle, "doc long, start long, n int, route long")
    settled = materialize(settled, "settled")
    asked = settled.filter("route is not null")
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("route", "start", "n")).alias("wanted"))
    near = passing(texts, "doc", key_filter(asked, "doc")).select("doc", "text")
    kind = "route long, doc long, start long, n int, block binary"
    blocks = materialize(near.join(wanted, "doc").mapInArrow(_fetch, kind), "ranges")
    runs = [settled.filter("route is null").select("doc", "start", "n")]
    for prefix in (32, 64, WINDOW, None):
        runs.append(blocks.filter("route is null").select("doc", "start", "n"))
        blocks = blocks.filter("route is not null")
        counts = blocks.groupBy("route").agg(F.count("*").alias("k"))
        many = materialize(counts.filter(F.col("k") > most_ranges).select("route"), "large_routes")
        last = prefix is None or many.isEmpty()
        few = blocks if last else blocks.join(many, "route", "left_anti").select(*blocks.columns)
        runs.append(few.repartition("route").sortWithinPartitions("route").mapInArrow(_sorted, _RUNS))
        if last:
            break
        blocks = materialize(blocks.join(many, "route", "left_semi").select(*blocks.columns).mapInArrow(_by_prefix(prefix), kind), "windows")
    return reduce(DataFrame.unionByName, runs)


def without_repeats(docs: DataFrame, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    runs = materialize(repeated_ranges(docs, most_ranges), "repeats")
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    told = flagged(texts, "doc", key_filter(runs, "doc"))
    cut = told.filter("__maybe").select("doc", "text").join(by_doc, "doc", "left")
    # Documents that surely have no repeats are only counted and hashed, where they lie.
    whole = told.filter("not __maybe").select("doc", "text", F.lit(None).cast("array<struct<start:long,n:int>>").alias("runs"))
    done = cut.unionByName(whole).mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
