"""The augmented Dickey-Fuller test on many frames at once."""

from __future__ import annotations

import numpy as np

PIVOT = 1e-12

# fixed values: p-values at the statistics -6, -5.8, ..., 2.8 (MacKinnon 2010), constant and constant with trend
P_VALUES = {
    "c": [
        1.6661204834e-07, 4.6549534731e-07, 1.2711717107e-06, 3.3872038899e-06,
        8.7920835785e-06, 2.2193154714e-05, 5.4385935695e-05, 1.2916964005e-04,
        2.9683262235e-04, 6.5890020605e-04, 1.4105112530e-03, 2.9073149933e-03,
        5.7610277513e-03, 1.0958871608e-02, 1.9984679219e-02, 3.4894400275e-02,
        5.8273768069e-02, 9.2997267439e-02, 1.4173640869e-01, 2.0624545685e-01,
        2.8657309917e-01, 3.8046169361e-01, 4.8359346965e-01, 5.8227611852e-01,
        6.7359571193e-01, 7.5326430120e-01, 8.1912206764e-01, 8.7098202687e-01,
        9.1009877736e-01, 9.3852161743e-01, 9.5853208606e-01, 9.7226159393e-01,
        9.8149494162e-01, 9.8761562917e-01, 9.9163616803e-01, 9.9426594855e-01,
        9.9598588316e-01, 9.9711414191e-01, 9.9785757578e-01, 9.9834901705e-01,
        9.9867295120e-01, 9.9888250502e-01, 9.9901030962e-01, 9.9907515515e-01,
        1.0000000000e+00,
    ],
    "ct": [
        2.1968599946e-06, 5.7220010110e-06, 1.4572870684e-05, 3.6209697180e-05,
        8.7581674237e-05, 2.0574728264e-04, 4.6839591299e-04, 1.0310555371e-03,
        2.1897009369e-03, 4.4769711121e-03, 8.7937012311e-03, 1.6560672206e-02,
        2.9846151131e-02, 5.1387926684e-02, 8.4401702427e-02, 1.3208098478e-01,
        1.9694444231e-01, 2.7989264978e-01, 3.7961893275e-01, 4.8985051943e-01,
        6.0143377224e-01, 7.0475832317e-01, 7.9243229243e-01, 8.6091256022e-01,
        9.1050285805e-01, 9.4411471090e-01, 9.6568254785e-01, 9.7895129765e-01,
        9.8687903442e-01, 9.9153194645e-01, 9.9423316769e-01, 9.9577753487e-01,
        9.9661680562e-01, 9.9698697776e-01, 1.0000000000e+00, 1.0000000000e+00,
        1.0000000000e+00, 1.0000000000e+00, 1.0000000000e+00, 1.0000000000e+00,
        1.0000000000e+00, 1.0000000000e+00, 1.0000000000e+00, 1.0000000000e+00,
        1.0000000000e+00,
    ],
}


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(solutions, singular) of stacked systems a x = b with several right-hand sides each.

    Row-pivoted elimination; a pivot below an absolute threshold makes a system singular.
    """
    system = np.concatenate([a, b], 2)
    m, p = a.shape[:2]
    every = np.arange(m)
    singular = np.zeros(m, bool)
    for k in range(p):
        pivot = k + np.argmax(np.abs(system[:, k:, k]), 1)
        swap = system[every, pivot].copy()
        system[every, pivot] = system[:, k]
        system[:, k] = swap
        lead = swap[:, k]
        singular |= ~(np.abs(lead) >= PIVOT)
        factor = system[:, k + 1 :, k] / np.where(lead == 0, 1, lead)[:, None]
        system[:, k + 1 :] -= factor[:, :, None] * system[:, k, None, :]
    x = np.zeros_like(b)
    for k in range(p - 1, -1, -1):
        rest = system[:, k, p:] - np.einsum("mj,mjr->mr", system[:, k, k + 1 : p], x[:, k + 1 :])
        x[:, k] = rest / np.where(system[:, k, k] == 0, 1, system[:, k, k])[:, None]
    return x, singular


def statistic(frames: np.ndarray, lags: int, regression: str) -> np.ndarray:
    """The t-value of the lagged level in the regression of the differences; NaN where it isn't defined."""
    m, w = frames.shape
    n = w - 1 - lags
    level = 1 if regression == "c" else 2
    p = level + 1 + lags
    if n <= p:
        return np.full(m, np.nan)
    diff = np.diff(frames, axis=1)
    design = np.empty((m, n, p))
    design[:, :, 0] = 1.0
    if level == 2:
        design[:, :, 1] = np.arange(lags, lags + n)
    design[:, :, level] = frames[:, lags : lags + n]
    for j in range(lags):
        design[:, :, level + 1 + j] = diff[:, lags - 1 - j : lags - 1 - j + n]
    y = diff[:, lags : lags + n]
    square = np.einsum("mnp,mnq->mpq", design, design)
    sides = np.zeros((m, p, 2))
    sides[:, :, 0] = np.einsum("mnp,mn->mp", design, y)
    sides[:, level, 1] = 1.0
    x, singular = solve(square, sides)
    rest = y - np.einsum("mnp,mp->mn", design, x[:, :, 0])
    variance = (rest * rest).sum(1) / (n - p) * x[:, level, 1]
    good = ~singular & (variance > 0)
    out = np.where(good, x[:, level, 0] / np.sqrt(np.where(good, variance, 1)), np.nan)
    return np.where(np.isfinite(out), out, np.nan)


def p_value(stat: np.ndarray, regression: str) -> np.ndarray:
    """Interpolated between the table's points and held constant beyond them; NaN for NaN."""
    table = P_VALUES[regression]
    at = -6.0 + 0.2 * np.arange(len(table))
    return np.where(np.isnan(stat), np.nan, np.interp(stat, at, table))
