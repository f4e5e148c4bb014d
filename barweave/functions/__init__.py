"""Column functions: null handling, guarded frames, returns, bar terms, checks and diagnostics."""

from .columns import clean, difference_quotient, is_inf, is_none, is_valid, lag, lead, linear_slope, pairwise, rolling, shift, std_dev
from .diagnostics import diagnostics

__all__ = ["clean", "diagnostics", "difference_quotient", "is_inf", "is_none", "is_valid", "lag", "lead", "linear_slope", "pairwise", "rolling", "shift", "std_dev"]
