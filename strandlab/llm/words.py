"""Vectorised words, word hashes and n-gram hashes of Arrow string arrays (numpy over the UTF-8 buffers, no loop over
words). Hashes are 64-bit and depend on nothing but the text, so all workers and runs agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that are hashed at a time, rounded up to whole documents.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()
    n = len(column)
    if n == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE_BYTES of text each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs without blanks within each row, and each row's first word (one more
    than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """One 64-bit hash for each word; lower: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _BYTE
    if lower:
        table = _BYTE.copy()
        table[65:91] = _BYTE[97:123]
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data] * powers(_BASE, n), out=total[1:])
        own = (total[ends] - total[starts]) * powers(_INVERSE, n)[starts]
        return mix(own + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for every i that has so many after it (rows aren't looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if k <= 6:
            out = np.zeros(n, np.uint64)
            for j in range(k):
                out = out * U(0xD6E8FEB86659FD93) + words[j : j + n]
            return mix(out)
        total = np.empty(len(words) + 1, np.uint64)
        total[0] = 0
        np.cumsum(words * powers(_BASE, len(words)), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(_INVERSE, len(words))[:n])


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run of words, starts[i] to ends[i]."""
    with np.errstate(over="ignore"):
        total = np.empty(len(words) + 1, np.uint64)
        total[0] = 0
        np.cumsum(words * powers(_BASE, len(words)), out=total[1:])
        own = (total[ends] - total[starts]) * powers(_INVERSE, len(words))[starts]
        return mix(own + (ends - starts).astype(np.uint64) * U(0x9E3779B97F4A7C15))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, end row, bytes, offsets from 0."""
    data, offsets = buffers(batch.column(name))
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, rows after another, and each row's first (one more than rows). A row with
    1 .. k-1 words has its whole sequence as the only one; a row without words has none."""
    counts = np.diff(rows)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    grams = gram_hashes(words, k)
    out = np.empty(int(first[-1]), np.uint64)
    full = counts >= k
    if full.any():
        at = np.repeat(rows[:-1][full] - first[:-1][full], many[full]) + np.flatnonzero(np.repeat(full, many))
        out[np.repeat(full, many)] = grams[at]
    for i in np.flatnonzero((counts > 0) & ~full):
        own = words[rows[i] : rows[i + 1]]
        with np.errstate(over="ignore"):
            h = U(len(own)) * U(0xA24BAED4963EE407)
            for x in own:
                h = h * U(0x9FB21C651E98DF25) + x
        out[first[i]] = mix(np.array([h]))[0]
    return out, first
