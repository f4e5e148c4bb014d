"""Vectorised computations over the frames of one series. NaN stands for null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STEP = 1 << 18  # values of frames held at once


def framed(x: np.ndarray, window: int, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """compute(frames) at every row whose `window` last rows hold no null; NaN elsewhere."""
    return framed_many([x], window, compute, 1)[0]


def framed_many(xs: list[np.ndarray], window: int, compute: Callable, n_out: int, present: np.ndarray | None = None) -> list[np.ndarray]:
    """The same with several aligned inputs and outputs; `present` tells which rows count as valid."""
    n = len(xs[0])
    out = [np.full(n, np.nan) for _ in range(n_out)]
    if n < window:
        return out
    if present is None:
        present = ~np.logical_or.reduce([np.isnan(x) for x in xs])
    missing = np.concatenate([[0], np.cumsum(~present)])
    ends = np.flatnonzero(missing[window:] == missing[:-window])
    step = max(1, STEP // window)
    views = [np.lib.stride_tricks.sliding_window_view(x, window) for x in xs]
    with np.errstate(all="ignore"):
        for a in range(0, len(ends), step):
            at = ends[a : a + step]
            got = compute(*[v[at] for v in views])
            for o, g in zip(out, got if n_out > 1 else [got]):
                g = np.asarray(g, float)
                o[at + window - 1] = g
    return out


def moments(frames: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mean, sums of powers 2..most of deviations); exactly zero where a frame is constant."""
    mean = frames.mean(1)
    flat = frames.max(1) == frames.min(1)
    mean = np.where(flat, frames[:, 0], mean)
    d = np.where(flat[:, None], 0.0, frames - mean[:, None])
    return mean, [(d**k).sum(1) for k in range(2, most + 1)]


def co_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Sxx, Syy, Sxy) of frames; zero for constant ones."""
    mx, (sxx,) = moments(x, 2)
    my, (syy,) = moments(y, 2)
    return sxx, syy, ((x - mx[:, None]) * (y - my[:, None])).sum(1)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is zero."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1, b))


def line(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope, R squared) of y on x in frames."""
    sxx, syy, sxy = co_moments(x, y)
    slope = ratio(sxy, sxx)
    return slope, ratio(slope * sxy, syy)


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sxx, syy, sxy = co_moments(x, y)
    return ratio(sxy, np.sqrt(sxx * syy))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks within each frame, equal values sharing the mean of theirs."""
    order = np.argsort(x, 1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    n = x.shape[1]
    place = np.broadcast_to(np.arange(n), x.shape)
    new = np.ones(x.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    last_new = np.ones(x.shape, bool)
    last_new[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(last_new, place, n)[:, ::-1], 1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return pearson(average_ranks(x), average_ranks(y))


def kendall(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tau-b, one pair distance at a time, so memory stays that of the frames."""
    n = x.shape[1]
    balance = np.zeros(len(x))
    loose_x, loose_y = np.zeros(len(x)), np.zeros(len(x))
    for k in range(1, n):
        a, b = np.sign(x[:, k:] - x[:, :-k]), np.sign(y[:, k:] - y[:, :-k])
        balance += (a * b).sum(1)
        loose_x += np.count_nonzero(a, 1)
        loose_y += np.count_nonzero(b, 1)
    return ratio(balance, np.sqrt(loose_x * loose_y))


CORRELATIONS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def entropy(frames: np.ndarray, bins: int, normalize: bool) -> np.ndarray:
    """Entropy in nats of the values' histogram between each frame's least and largest; 0 if they are equal."""
    least = frames.min(1, keepdims=True)
    span = frames.max(1, keepdims=True) - least
    flat = span[:, 0] == 0
    place = np.where(flat[:, None], 0.0, (frames - least) / np.where(span == 0, 1, span) * bins)
    place = np.minimum(np.nan_to_num(place, nan=0.0, posinf=bins - 1, neginf=0).astype(np.int64), bins - 1)
    rows = np.arange(len(frames))[:, None]
    p = np.bincount((rows * bins + place).ravel(), minlength=len(frames) * bins).reshape(-1, bins) / frames.shape[1]
    h = -(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)).sum(1)
    h = h / np.log(bins) if normalize else h
    return np.where(flat, 0.0, h + 0.0)


def recurrence(x: np.ndarray, gain: np.ndarray, seed: np.ndarray, held: float, skip: int) -> tuple[np.ndarray, float]:
    """(s, last s): s[t] = b + gain[t] * (x[t] - b), where b is s[t-1] or, without one, seed[t]. A NaN gain ends the run."""
    out = np.full(len(x), np.nan)
    for t, (v, g, s) in enumerate(zip(x[skip:].tolist(), gain[skip:].tolist(), seed[skip:].tolist()), skip):
        if g != g:
            held = np.nan
            continue
        base = held if held == held else s
        held = out[t] = base + g * (v - base)
    return out, held
