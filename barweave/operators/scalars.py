"""Stateless arithmetic on one or two columns. A null operand gives null."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import functions as F

from .base import Sequence, Transform


@dataclass(frozen=True)
class _Scalar(Transform):
    outputs: Sequence[str]

    def kernel(self, x, skip, state):
        with np.errstate(all="ignore"):
            out = self.compute(*x)
        return [np.where(np.isnan(out), np.nan, out)], state

    def plan(self, x, terms, order):
        return [self.column(*x)]


@dataclass(frozen=True)
class _Binary(_Scalar):
    N_IN: ClassVar = (2, 2)


@dataclass(frozen=True)
class _Unary(_Scalar):
    N_IN: ClassVar = (1, 1)


class Add(_Binary):
    """a + b"""

    column = staticmethod(lambda a, b: a + b)
    compute = staticmethod(lambda a, b: a + b)


class Subtract(_Binary):
    """a - b"""

    column = staticmethod(lambda a, b: a - b)
    compute = staticmethod(lambda a, b: a - b)


class Multiply(_Binary):
    """a * b"""

    column = staticmethod(lambda a, b: a * b)
    compute = staticmethod(lambda a, b: a * b)


class Divide(_Binary):
    """a / b; null where b is zero"""

    column = staticmethod(lambda a, b: F.try_divide(a, b))
    compute = staticmethod(lambda a, b: np.where(b == 0, np.nan, a / b))


class Reciprocal(_Unary):
    """1 / x; null where x is zero"""

    column = staticmethod(lambda x: F.try_divide(F.lit(1.0), x))
    compute = staticmethod(lambda x: np.where(x == 0, np.nan, 1 / x))


class Log(_Unary):
    """The natural logarithm; null where x <= 0"""

    column = staticmethod(lambda x: F.when(x > 0, F.ln(x)))
    compute = staticmethod(lambda x: np.where(x > 0, np.log(np.where(x > 0, x, 1)), np.nan))


class NegLog(_Unary):
    """Minus the natural logarithm; null where x <= 0"""

    column = staticmethod(lambda x: F.when(x > 0, -F.ln(x)))
    compute = staticmethod(lambda x: np.where(x > 0, -np.log(np.where(x > 0, x, 1)), np.nan))


class Logit(_Unary):
    """ln(x / (1 - x)); null outside the open interval (0, 1)"""

    column = staticmethod(lambda x: F.when((x > 0) & (x < 1), F.ln(x / (F.lit(1.0) - x))))
    compute = staticmethod(lambda x: np.where((x > 0) & (x < 1), np.log(np.where((x > 0) & (x < 1), x / (1 - np.where(x < 1, x, 0)), 1)), np.nan))
