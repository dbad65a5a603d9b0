"""Vectorised word and shingle hashing over Arrow text columns.

A chunk is a run of rows whose texts lie one after the other in one byte array. Hashes are
polynomial in a random value per byte, taken from prefix sums modulo 2^64, so that the hash
of any span costs one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: \x20 and \x09-\x0D, the separators of the contracts.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_LENGTH = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h.astype(U, copy=True)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[name] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``data``."""
    return prefix_hash_of(_BYTE[data])


def prefix_hash_of(values: np.ndarray) -> np.ndarray:
    """The same for a sequence of random values."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _power("down", pow(_BASE, -1, 1 << 64), len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal spans, wherever they stand."""
    h = (prefix[ends] - prefix[starts]) * _power("up", _BASE, len(prefix))[starts]
    return mix(h + (ends - starts).astype(U) * U(_LENGTH))


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """``span_hash`` of every run of ``k`` values (a power of two), from runs of half the length."""
    out, step = values, 1
    while step < k:
        out = out[: max(len(out) - step, 0)] + out[step:] * U(pow(_BASE, -step, 1 << 64))
        step *= 2
    return mix(out + U(k * _LENGTH & _MASK))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 21, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row bounds, bytes and row offsets of runs of ``rows`` rows and about ``limit`` bytes at most; null
    is the empty text. A longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for base in range(0, len(column), rows):
        part = column.slice(base, rows).cast(pa.large_string()).fill_null("")
        n = len(part)
        _, raw, body = part.buffers()
        offsets = np.frombuffer(raw, np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
            yield base + lo, base + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that aren't separators; rows part words."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~separators[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and how many words the rows before each row have (one more entry than rows)."""
    starts, ends, row = word_spans(data, offsets, separators)
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(row, np.arange(len(offsets)))


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(_BASE) + hashes[j : j + n]
    return mix(out + U(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``k`` words; with fewer words, of
    the whole sequence; empty without words."""
    hashes, at = word_hashes(LOWER[data], offsets)
    runs = combine(hashes, k)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= k:
            part = np.sort(runs[lo : hi - k + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            yield part[keep]
        elif hi > lo:
            yield combine(hashes[lo:hi], int(hi - lo))
        else:
            yield hashes[:0]
