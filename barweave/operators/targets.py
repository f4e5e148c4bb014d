"""Forward-looking targets. They are planned as window expressions and exist for batch only."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import difference_quotient, linear_slope, rolling
from .base import Sequence, Target
from .kernels import framed, framed_many, line, moments


def ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The value n rows later; NaN beyond the end."""
    return np.concatenate([x[n:], np.full(min(n, len(x)), np.nan)])


@dataclass(frozen=True)
class FutureReturn(Target):
    """Relative change to the value `horizon` rows ahead; only the two ends count, and the present one must be positive."""

    outputs: Sequence[str] = ()
    N_IN: ClassVar = (1, 1)

    def plan(self, x, terms, order):
        return [difference_quotient(F.lead(x[0], self.horizon).over(order), x[0], False)]

    def kernel(self, x):
        later = ahead(x[0], self.horizon)
        with np.errstate(all="ignore"):
            return [np.where(x[0] > 0, (later - x[0]) / x[0], np.nan)]


@dataclass(frozen=True)
class FutureCTCVolatility(Target):
    """Sample standard deviation of the next `horizon` one-row log returns. The output is {input}_future_ctc_vol_{horizon}."""

    outputs: tuple = field(init=False, default=())
    N_IN: ClassVar = (1, 1)
    LEAST: ClassVar[int] = 2

    def check(self):
        object.__setattr__(self, "outputs", (f"{self.inputs[0]}_future_ctc_vol_{self.horizon}",))

    def prepare(self, x, order):
        return [difference_quotient(x[0], F.lag(x[0], 1).over(order), True)]

    def plan(self, x, terms, order):
        return [rolling(lambda f: F.stddev_samp(terms[0]).over(f), terms[0], order, 1, self.horizon)]

    def kernel(self, x):
        v, before = x[0], np.concatenate([[np.nan], x[0]])[: len(x[0])]
        with np.errstate(all="ignore"):
            r = np.where((v > 0) & (before > 0), np.log(v / before), np.nan)
        return [ahead(framed(r, self.horizon, lambda f: np.sqrt(moments(f, 2)[1][0] / (self.horizon - 1))), self.horizon)]


@dataclass(frozen=True)
class FutureLinearSlope(Target):
    """(slope, R squared) of the second input on the first over this row and the horizon-1 after it."""

    outputs: Sequence[str] = ()
    N_IN: ClassVar = (2, 2)
    N_OUT: ClassVar[int] = 2
    LEAST: ClassVar[int] = 2

    def plan(self, x, terms, order):
        both = F.when(x[0].isNotNull() & x[1].isNotNull(), F.lit(1))
        return [rolling(f, both, order, 0, self.horizon - 1) for f in linear_slope(x[0], x[1])]

    def kernel(self, x):
        return [ahead(o, self.horizon - 1) for o in framed_many(x, self.horizon, line, 2)]
