"""Anchored windows: which windows of fixed length occur more than once in the corpus.

A window of W symbols (bytes or words) is anchored at the smallest hash among its grams (winnowing; the
leftmost on a tie). The anchor and its place depend on nothing but the window, so equal windows
have equal anchors at equal places, and only documents' anchors (one in some hundred bytes, or seven words) need
to meet. Consecutive windows with the same anchor form a run; `lo`..`hi` are their starts. Runs of
equal context (all symbols of all their windows) match wholly, which settles the inside of long
repeats by two hashes; only where contexts differ are the symbols themselves compared.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, powers

_B = np.uint64(0x2545F4914F6CDD1D)
_BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_PLACE = np.uint64((1 << 28) - 1)


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each `gram` consecutive symbols (shorter by gram-1): a polynomial of scrambled symbols, by doubling."""
    if symbols.dtype == np.uint8:
        h = _BYTES[symbols]
    else:
        h = mix64(symbols.astype(np.uint64) + np.uint64(0x1234567))
    size = 1
    with np.errstate(over="ignore"):
        while size < gram:
            step = min(size, gram - size)
            h = h[: len(h) - step] * np.uint64(pow(int(_B), step, 1 << 64)) + (h[step:] if step == size else h[step:] ^ np.uint64(step))
            size += step
    return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (shorter by width-1), by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def runs(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(anchor hash, context hash, row, lo, hi, anchor place) of each run; places count from the row's start.

    symbols: the rows' symbols one after another, at most 2**28 of them; offsets: where rows begin and end.
    """
    n = len(symbols)
    if n < window:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z
    g = gram_hashes(symbols, gram)
    place = np.arange(len(g), dtype=np.uint64)
    least = sliding_min((g & ~_PLACE) | place, window - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    valid = np.arange(len(least)) + window <= offsets[1:][row]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(change & valid)
    # a run ends before the next change or the row's last window
    breaks = np.flatnonzero(change)
    hi = np.append(breaks, len(least))[np.searchsorted(breaks, lo, "right")] - 1
    own = row[lo]
    hi = np.minimum(hi, offsets[1:][own] - window)
    at = (least[lo] & _PLACE).astype(np.int64)
    with np.errstate(over="ignore"):
        p = powers(_B, len(g))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * p, dtype=np.uint64)])
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        back = powers(inverse, len(g))[lo]
        context = mix64((total[hi + window - gram + 1] - total[lo]) * back + (hi - lo).astype(np.uint64) * _B + (at - lo).astype(np.uint64))
    base = offsets[own]
    return g[at], context, own, lo - base, hi - base, at - base
