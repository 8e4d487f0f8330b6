"""Banded alignment of two word sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions, deletions and substitutions from ``a`` to ``b``; None if over ``most``.

    The band of diagonals is narrow at first and widened until the distance lies inside it.
    """
    if abs(len(a) - len(b)) > most:
        return None
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    start = int(differ[0]) if len(differ) else size
    differ = np.flatnonzero(a[len(a) - size + start :][::-1] != b[len(b) - size + start :][::-1])
    end = int(differ[0]) if len(differ) else size - start
    first, second = a[start : len(a) - end].tolist(), b[start : len(b) - end].tolist()
    if not first or not second:
        return max(len(first), len(second))
    band = min(most, max(32, abs(len(a) - len(b))))
    while True:
        found = _in_band(first, second, band)
        if found <= band:
            return found
        if band >= most:
            return None
        band = min(most, band * 4)


def _in_band(a: list[int], b: list[int], band: int) -> int:
    """The distance if it is at most ``band``, else some number above that.

    Dynamic programming over the columns of ``b``. A column holds the rows within ``band`` of
    the diagonal, as two integers whose bits say where the distance rises or falls by one from
    a row to the next; cells outside the band count as one more than their neighbours inside.
    Rows before the first count down to it, so that the upper edge needs no case of its own.
    """
    width = 2 * band + 1
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, list[int]] = {}
    for row, word in enumerate(a, 1):
        places.setdefault(word, []).append(row)
    falls = (1 << (band + 1)) - 1
    rises = mask ^ falls
    lowest = band  # the distance in the band's last row
    for column, word in enumerate(b, 1):
        rises, falls = rises >> 1 | bottom, falls >> 1
        top = column - band
        equal = 0
        rows = places.get(word)
        if rows:
            for row in rows[bisect_left(rows, top) : bisect_right(rows, column + band)]:
                equal |= 1 << (row - top)
        same = ((((equal & rises) + rises) ^ rises) | equal | falls) & mask
        if not same & bottom:
            lowest += 1
        right_up = falls | (mask ^ (same | rises))
        right_down = same & rises
        right_up = (right_up << 1 | 1) & mask
        right_down = right_down << 1 & mask
        rises = right_down | (mask ^ (same | right_up))
        falls = right_up & same
    below = len(a) - (len(b) - band) + 1
    return lowest - (rises >> below).bit_count() + (falls >> below).bit_count()


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words in both, with repetitions: no alignment can keep more of them."""
    values_a, counts_a = np.unique(a, return_counts=True)
    values_b, counts_b = np.unique(b, return_counts=True)
    _, in_a, in_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    return int(np.minimum(counts_a[in_a], counts_b[in_b]).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float | None:
    """1 - distance / longer length, or None where that is under ``least``."""
    longer = max(len(a), len(b))
    if longer == 0:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if longer - shared_words(a, b) > most:
        return None
    edits = edit_distance(a, b, most)
    return None if edits is None else 1 - edits / longer
