"""Banded alignment of word sequences."""

from __future__ import annotations

import numpy as np


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Levenshtein distance of two integer sequences, or limit + 1 where it is larger.

    Only the band of 2 * limit + 1 diagonals is computed, a column at a time as the bits of one
    integer (the bit-parallel band of Hyyro, 2003), after equal ends are stripped.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    n = len(b)
    same = a[:n] == b
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = len(b)
    if n:
        same = a[len(a) - n :][::-1] == b[::-1]
        tail = n if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: n - tail]
    if not len(b):
        return len(a)
    if limit <= 0:
        return limit + 1
    limit = min(limit, len(a))
    masks: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | (1 << i)
    width = 2 * limit + 2
    full = (1 << width) - 1
    top = 1 << (width - 1)
    row = 1 << (width - 2)
    plus = (full << (width - limit - 1)) & full
    minus = 0
    distance = limit
    start = limit + 1 - width
    give_up = limit + len(b) - (len(a) - limit)
    corner = len(a) - limit
    for j, word in enumerate(b.tolist()):
        mask = masks.get(word, 0)
        mask = ((mask >> start) if start >= 0 else (mask << -start)) & full
        zero = ((((mask & plus) + plus) ^ plus) | mask | minus) & full
        right = (minus | ~(zero | plus)) & full
        down = zero & plus
        if j < corner:
            distance += not zero & top
        else:
            distance += bool(right & row)
            distance -= bool(down & row)
            row >>= 1
        if distance > give_up:
            return limit + 1
        zero >>= 1
        plus = (down | ~(zero | right)) & full
        minus = zero & right
        start += 1
    return distance if distance <= limit else limit + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - distance / longer length is at least the given similarity; two empty sequences are alike."""
    longer = max(len(a), len(b))
    limit = int((1 - least) * longer + 1e-9)
    return banded_distance(a, b, limit) <= limit


FINE, COARSE = 1024, 128


def histogram(words: np.ndarray) -> np.ndarray:
    """Word counts by the low bits of the word; half the L1 distance of two bounds their edit distance from below."""
    return np.bincount((words & words.dtype.type(FINE - 1)).astype(np.int64), minlength=FINE).astype(np.int32)


def coarser(fine: np.ndarray) -> np.ndarray:
    """Histograms of fewer bins, for a first and cheaper bound."""
    return fine.reshape(*fine.shape[:-1], FINE // COARSE, COARSE).sum(axis=-2)


def cut_points(longest: int) -> list[int]:
    """16, 24, 32, 48, 64, ... below the longest length."""
    out, n = [], 16
    while n < longest:
        out += [n, n * 3 // 2]
        n *= 2
    return [c for c in out if c < longest]


def split_histograms(words: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Coarse histograms of the words before and after each cut: (cut, side, bin).

    For two sequences, an alignment of distance d meets a cut of one within d of the same cut of
    the other, at a distance of d1 before and d2 after it, d1 + d2 = d; each side's L1 distance is
    at most 3 d1 or 3 d2. A third of both sides' L1 thus bounds the distance from below, and tells
    texts whose parts have changed places.
    """
    low = (words & words.dtype.type(COARSE - 1)).astype(np.int64)
    whole = np.bincount(low, minlength=COARSE)
    ahead = np.stack([np.bincount(low[:c], minlength=COARSE) for c in cuts]) if cuts else np.zeros((0, COARSE), np.int64)
    return np.stack((ahead, whole[None, :] - ahead), axis=1).astype(np.int32)
