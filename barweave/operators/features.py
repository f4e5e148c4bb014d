"""Rolling features."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import functions as F

from ..errors import InvalidConfigError, InvalidInputError
from ..functions.columns import difference_quotient, linear_slope, rolling
from . import stationarity
from .base import Sequence, Transform, whole
from .kernels import CORRELATIONS, entropy, framed, framed_many, line, moments, ratio, recurrence


@dataclass(frozen=True)
class _Rolling(Transform):
    """A function of the last `window` rows."""

    window: int
    outputs: Sequence[str]
    LEAST: ClassVar[int] = 1
    #: Spark's sliding frames start anew for each row, so their cost grows with the window; beyond this one
    #: the vectorised kernel is faster, Arrow transfer included (measured on 20,000-row series).
    WIDEST_PLAN: ClassVar[int] = 32

    def check(self):
        self.settle("window", whole("window", self.window, self.LEAST))

    @property
    def native(self):
        return self.window <= self.WIDEST_PLAN

    def warm_up_period(self):
        return self.window - 1


class Sma(_Rolling):
    """Arithmetic mean."""

    def plan(self, x, terms, order):
        return [rolling(lambda f: F.avg(x[0]).over(f), x[0], order, 1 - self.window, 0)]

    def kernel(self, x, skip, state):
        return [framed(x[0], self.window, lambda f: f.mean(1))], state


class Mma(_Rolling):
    """Median; the mean of both middle values where the window is even."""

    WIDEST_PLAN = 8

    def plan(self, x, terms, order):
        return [rolling(lambda f: F.percentile(x[0], F.lit(0.5)).over(f), x[0], order, 1 - self.window, 0)]

    def kernel(self, x, skip, state):
        return [framed(x[0], self.window, lambda f: np.median(f, 1))], state


class Ema(_Rolling):
    """Exponential average with factor 2 / (window + 1), seeded by the mean of `window` consecutive values.

    A null ends it: the next `window` values seed it anew. So the value depends on the rows since the last null.
    """

    STATE = 2  # last average, consecutive values so far

    @property
    def native(self):
        return False

    def kernel(self, x, skip, state):
        v, w = x[0], self.window
        valid = ~np.isnan(v)
        place = np.arange(len(v))
        start = np.maximum.accumulate(np.where(valid, -1, place))  # the last null
        before = state[1] if state[1] == state[1] else 0.0
        run = np.where(start >= skip, place - start, place - skip + 1 + before)
        seed = framed(v, w, lambda f: f.mean(1))
        gain = np.where(valid & (run >= w), np.where(run == w, 0.0, 2.0 / (w + 1)), np.nan)
        out, held = recurrence(v, gain, seed, state[0], skip)
        return [out], [held, float(run[-1]) if valid[-1] else 0.0]


@dataclass(frozen=True)
class Kama(_Rolling):
    """Kaufman's adaptive average: an exponential one whose factor follows the efficiency of the last moves.

    It starts, and after a null starts again, from the row before the first whole frame of window + 1 rows.
    """

    fast: int = 2
    slow: int = 30
    STATE: ClassVar[int] = 1

    def check(self):
        super().check()
        self.settle("fast", whole("fast", self.fast, 1))
        self.settle("slow", whole("slow", self.slow, 1))
        if self.slow <= self.fast:
            raise InvalidInputError(f"slow must exceed fast, not {self.slow} and {self.fast}")

    @property
    def native(self):
        return False

    def warm_up_period(self):
        return self.window

    def kernel(self, x, skip, state):
        v = x[0]
        quick, lazy = 2.0 / (self.fast + 1), 2.0 / (self.slow + 1)

        def factor(f):
            path = np.abs(np.diff(f, axis=1)).sum(1)
            efficiency = np.where(path == 0, 0.0, np.abs(f[:, -1] - f[:, 0]) / np.where(path == 0, 1, path))
            return (efficiency * (quick - lazy) + lazy) ** 2

        gain = framed(v, self.window + 1, factor)
        out, held = recurrence(v, gain, np.concatenate([[np.nan], v[:-1]]), state[0], skip)
        return [out], [held]


@dataclass(frozen=True)
class _Return(_Rolling):
    LOG: ClassVar[bool] = False

    @property
    def native(self):
        return True

    def warm_up_period(self):
        return self.window

    def plan(self, x, terms, order):
        return [difference_quotient(x[0], F.lag(x[0], self.window).over(order), self.LOG)]

    def kernel(self, x, skip, state):
        v, w = x[0], self.window
        p = np.concatenate([np.full(w, np.nan), v])[: len(v)]
        with np.errstate(all="ignore"):
            out = np.where((p > 0) & (v > 0), np.log(v / p), np.nan) if self.LOG else np.where(p > 0, (v - p) / p, np.nan)
        return [out], state


class SimpleReturn(_Return):
    """Relative change over `window` rows; null if either end is null or the earlier one not positive."""


class LogReturn(_Return):
    """Logarithm of the ratio over `window` rows; null unless both ends are positive."""

    LOG = True


class LinearSlope(_Rolling):
    """(slope, R squared) of the second input on the first; both null if the first is constant, R squared also if the second is."""

    N_IN = (2, None)
    N_OUT = 2
    LEAST = 2
    WIDEST_PLAN = 16

    def plan(self, x, terms, order):
        both = F.when(x[0].isNotNull() & x[1].isNotNull(), F.lit(1))
        return [rolling(f, both, order, 1 - self.window, 0) for f in linear_slope(x[0], x[1])]

    def kernel(self, x, skip, state):
        return framed_many(x[:2], self.window, line, 2), state


@dataclass(frozen=True)
class _BarVolatility(_Rolling):
    """The root of a mean of per-bar terms; an invalid bar is a null term."""

    def term(self, x, m):
        raise NotImplementedError

    def prepare(self, x, order):
        return [self.term(x, F)]

    def plan(self, x, terms, order):
        def root(f):
            mean = F.avg(terms[0]).over(f) / F.lit(self.SCALE)
            return F.when(mean >= 0, F.sqrt(mean))

        return [rolling(root, terms[0], order, 1 - self.window, 0)]

    def kernel(self, x, skip, state):
        with np.errstate(all="ignore"):
            t = self.numbers(*x)

        def root(f):
            mean = f.mean(1) / self.SCALE
            return np.where(mean >= 0, np.sqrt(np.where(mean >= 0, mean, 0)), np.nan)

        return [framed(t, self.window, root)], state


class ParkinsonVolatility(_BarVolatility):
    """From high and low: the root of the mean squared log range over 4 ln 2."""

    N_IN = (2, None)
    SCALE = 4 * math.log(2)

    def term(self, x, m):
        h, low = x[0], x[1]
        return F.when((h > 0) & (low > 0) & (h >= low), F.pow(F.ln(h / low), F.lit(2.0)))

    @staticmethod
    def numbers(h, low, *_):
        return np.where((h > 0) & (low > 0) & (h >= low), np.log(h / low) ** 2, np.nan)


class RogersSatchellVolatility(_BarVolatility):
    """From high, low, open and close; drift-free. Null where the mean term is negative."""

    N_IN = (4, None)
    SCALE = 1.0

    def term(self, x, m):
        h, low, o, c = x[:4]
        good = (h > 0) & (low > 0) & (o > 0) & (c > 0) & (h >= low)
        return F.when(good, F.ln(h / c) * F.ln(h / o) + F.ln(low / c) * F.ln(low / o))

    @staticmethod
    def numbers(h, low, o, c, *_):
        good = (h > 0) & (low > 0) & (o > 0) & (c > 0) & (h >= low)
        return np.where(good, np.log(h / c) * np.log(h / o) + np.log(low / c) * np.log(low / o), np.nan)


class Skewness(_Rolling):
    """Bias-corrected sample skewness; null for a constant frame."""

    LEAST = 3

    def plan(self, x, terms, order):
        n = self.window
        factor = math.sqrt(n * (n - 1)) / (n - 2)
        return [rolling(lambda f: F.skewness(x[0]).over(f) * F.lit(factor), x[0], order, 1 - n, 0)]

    def kernel(self, x, skip, state):
        n = self.window

        def skew(f):
            _, (m2, m3) = moments(f, 3)
            return ratio(m3 * n * math.sqrt(n - 1) / (n - 2), m2**1.5)

        return [framed(x[0], n, skew)], state


class Kurtosis(_Rolling):
    """Bias-corrected sample excess kurtosis; null for a constant frame."""

    LEAST = 4

    def plan(self, x, terms, order):
        n = self.window
        return [rolling(lambda f: (F.kurtosis(x[0]).over(f) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3)), x[0], order, 1 - n, 0)]

    def kernel(self, x, skip, state):
        n = self.window

        def kurt(f):
            _, (m2, _, m4) = moments(f, 4)
            return ((n + 1) * (ratio(m4 * n, m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))

        return [framed(x[0], n, kurt)], state


@dataclass(frozen=True)
class _Correlated(_Rolling):
    LEAST: ClassVar[int] = 2

    def check(self):
        super().check()
        if self.method not in CORRELATIONS:
            raise InvalidConfigError(f"method must be one of {sorted(CORRELATIONS)}, not {self.method!r}")

    @property
    def native(self):
        return self.method == "pearson" and self.window <= self.WIDEST_PLAN

    def pearson(self, x, y, order):
        def r(f):
            return F.try_divide(F.regr_sxy(y, x).over(f), F.sqrt(F.regr_sxx(y, x).over(f) * F.regr_syy(y, x).over(f)))

        both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
        return rolling(r, both, order, 1 - self.window, 0)


@dataclass(frozen=True)
class Correlation(_Correlated):
    """Pearson's, Spearman's (mean ranks) or Kendall's (tau-b) correlation; null if either side is constant."""

    method: str = "pearson"
    N_IN: ClassVar = (2, None)

    def plan(self, x, terms, order):
        return [self.pearson(x[0], x[1], order)]

    def kernel(self, x, skip, state):
        return framed_many(x[:2], self.window, CORRELATIONS[self.method], 1), state


@dataclass(frozen=True)
class AutoCorrelation(_Correlated):
    """Correlation of the last `window` rows with those `lag` rows before."""

    lag: int = 1
    method: str = "pearson"
    N_IN: ClassVar = (1, 1)

    def check(self):
        super().check()
        self.settle("lag", whole("lag", self.lag, 1))

    def warm_up_period(self):
        return self.window + self.lag - 1

    def prepare(self, x, order):
        return [F.lag(x[0], self.lag).over(order)]

    def plan(self, x, terms, order):
        return [self.pearson(x[0], terms[0], order)]

    def kernel(self, x, skip, state):
        late = np.concatenate([np.full(self.lag, np.nan), x[0]])[: len(x[0])]
        return framed_many([x[0], late], self.window, CORRELATIONS[self.method], 1), state


@dataclass(frozen=True)
class ShannonEntropy(_Rolling):
    """Entropy of a histogram of the frame; bins by Sturges' rule unless given, over ln(bins) if normalized."""

    bins: int | None = None
    normalize: bool = True
    LEAST: ClassVar[int] = 2

    def check(self):
        super().check()
        if self.bins is not None:
            self.settle("bins", whole("bins", self.bins, 2))

    @property
    def native(self):
        return False

    def bin_count(self) -> int:
        return self.bins if self.bins is not None else math.ceil(1 + math.log2(self.window))

    def kernel(self, x, skip, state):
        return [framed(x[0], self.window, lambda f: entropy(f, self.bin_count(), self.normalize))], state


@dataclass(frozen=True)
class Adf(_Rolling):
    """(statistic, p-value) of the augmented Dickey-Fuller test; lags by Schwert's rule unless given.

    regression: 'c' with a constant, 'ct' also with a trend.
    """

    lags: int | None = None
    regression: str = "c"
    N_OUT: ClassVar[int] = 2

    def check(self):
        super().check()
        if self.regression not in stationarity.P_VALUES:
            raise InvalidConfigError(f"regression must be 'c' or 'ct', not {self.regression!r}")
        if self.lags is not None:
            self.settle("lags", whole("lags", self.lags, 0))
        if self.window <= 3 + 2 * self.lag_count():
            raise InvalidInputError(f"window must exceed 3 + 2 * lags = {3 + 2 * self.lag_count()}, not {self.window}")

    @property
    def native(self):
        return False

    def lag_count(self) -> int:
        return self.lags if self.lags is not None else math.floor(12 * (self.window / 100) ** 0.25)

    def kernel(self, x, skip, state):
        def test(f):
            s = stationarity.statistic(f, self.lag_count(), self.regression)
            return s, stationarity.p_value(s, self.regression)

        return framed_many(x[:1], self.window, test, 2), state
