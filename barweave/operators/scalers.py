"""Z-scores with rolling or fixed parameters, and the fit of the latter."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions.columns import clean, rolling
from .base import Sequence, Transform, whole
from .kernels import framed, moments


@dataclass(frozen=True)
class RollingZScore(Transform):
    """(x - mean) / sample standard deviation of the last `window` rows, the present one included; null if they are equal."""

    window: int
    outputs: Sequence[str]
    N_IN: ClassVar = (1, 1)

    WIDEST_PLAN: ClassVar[int] = 32  # see the rolling features

    def check(self):
        self.settle("window", whole("window", self.window, 2))

    @property
    def native(self):
        return self.window <= self.WIDEST_PLAN

    def warm_up_period(self):
        return self.window - 1

    def plan(self, x, terms, order):
        v = x[0]

        def score(frame):
            s = F.stddev_samp(v).over(frame)
            return F.when(s > 0, (v - F.avg(v).over(frame)) / s)

        return [rolling(score, v, order, 1 - self.window, 0)]

    def kernel(self, x, skip, state):
        def score(f):
            mean, dev = moments(f, 2)
            return np.where(dev[0] > 0, (f[:, -1] - mean) / np.sqrt(np.where(dev[0] > 0, dev[0], 1) / (self.window - 1)), np.nan)

        return [framed(x[0], self.window, score)], state


@dataclass(frozen=True)
class FixedZScore(Transform):
    """(x - mean) / std with given parameters."""

    outputs: Sequence[str]
    mean: float = 0.0
    std: float = 1.0
    N_IN: ClassVar = (1, 1)

    def check(self):
        if not (float(self.std) > 0 and math.isfinite(self.std)):
            raise InvalidInputError(f"std must be positive, not {self.std!r}")
        if not math.isfinite(self.mean):
            raise InvalidInputError(f"mean must be finite, not {self.mean!r}")

    def plan(self, x, terms, order):
        return [(x[0] - F.lit(float(self.mean))) / F.lit(float(self.std))]

    def kernel(self, x, skip, state):
        return [(x[0] - self.mean) / self.std], state


class StandardScalerParams(NamedTuple):
    mean: float
    std: float


def fit_standard_scaler(df: DataFrame | Sequence[float | None], column: str | None = None, key: list[str] | None = None) -> StandardScalerParams | DataFrame:
    """Mean and sample standard deviation of the non-null values: a tuple, or with `key` a row for each key.

    Under two values, or values all equal, are an error; per key they give null parameters. One hash aggregate.
    A local sequence of values can stand in for a table and column.
    """
    if column is None:
        v = np.array([x for x in df if x is not None and x == x], float)
        if len(v) < 2 or v.max() == v.min():
            raise InvalidInputError("at least two valid values that differ are needed")
        return StandardScalerParams(float(v.mean()), float(v.std(ddof=1)))
    x = clean(column)
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    if key:
        ok = (F.col("n") >= 2) & (F.col("s") > 0)
        found = df.groupBy(*key).agg(n.alias("n"), mean.alias("m"), std.alias("s"))
        return found.select(*key, F.when(ok, F.col("m")).alias("mean"), F.when(ok, F.col("s")).alias("std"))
    r = df.agg(n.alias("n"), mean.alias("m"), std.alias("s")).first()
    if r["n"] < 2:
        raise InvalidInputError("at least two valid values are needed")
    if not r["s"] > 0:
        raise InvalidInputError("all values are equal")
    return StandardScalerParams(r["m"], r["s"])
