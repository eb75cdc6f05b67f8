"""Vectorised text work on the UTF-8 bytes of Arrow string columns.

Words are runs of ASCII letters, digits, underscores and all non-ASCII bytes; ASCII letters are
lower-cased. Hashes are 64-bit polynomial prefix hashes with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD[95] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            full = np.full(size, _BASE, np.uint64)
            full[0] = 1
            _powers = np.cumprod(full)
            full = np.full(size, _BASE_INVERSE, np.uint64)
            full[0] = 1
            _inverse_powers = np.cumprod(full)
    return _powers[:n], _inverse_powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(large), b"" if large == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; one longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of inside that cross no row bound and no break (a run's new start)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if breaks is not None:
        cut[:n] |= breaks
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_text(text: str) -> int:
    """The hash that span_hash gives to a whole lower-cased text."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashes of the words."""
    starts, ends, rows = spans(IS_WORD[data], offsets)
    return starts, ends, rows, span_hash(prefix_hash(LOWER[data]), starts, ends)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and word positions of the k-word shingles; a row of 1 to k - 1 words is one shingle of all of them."""
    bounds = row_bounds(rows, n_rows)
    counts = np.diff(bounds)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    rows_padded = np.concatenate((rows, np.full(k, -1)))
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += np.where(rows_padded[j : j + n] == rows, padded[j : j + n] * weights[j], np.uint64(0))
    at = np.arange(n)
    first = bounds[rows] if n else at
    keep = (at + k <= bounds[rows + 1]) | ((at == first) & (counts[rows] < k)) if n else np.zeros(0, bool)
    return mix(total[keep] + np.uint64(k)), rows[keep], at[keep] - first[keep]
