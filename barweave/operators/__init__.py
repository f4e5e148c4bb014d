"""Specifications of all transforms and targets."""

from .base import Target, Transform
from .features import (
    Adf,
    AutoCorrelation,
    Correlation,
    Ema,
    Kama,
    Kurtosis,
    LinearSlope,
    LogReturn,
    Mma,
    ParkinsonVolatility,
    RogersSatchellVolatility,
    ShannonEntropy,
    SimpleReturn,
    Skewness,
    Sma,
)
from .scalars import Add, Divide, Log, Logit, Multiply, NegLog, Reciprocal, Subtract
from .scalers import FixedZScore, RollingZScore, StandardScalerParams, fit_standard_scaler
from .targets import FutureCTCVolatility, FutureLinearSlope, FutureReturn

__all__ = [
    "Adf", "Add", "AutoCorrelation", "Correlation", "Divide", "Ema", "FixedZScore", "FutureCTCVolatility",
    "FutureLinearSlope", "FutureReturn", "Kama", "Kurtosis", "LinearSlope", "Log", "LogReturn", "Logit", "Mma",
    "Multiply", "NegLog", "ParkinsonVolatility", "Reciprocal", "RogersSatchellVolatility", "RollingZScore",
    "ShannonEntropy", "SimpleReturn", "Skewness", "Sma", "StandardScalerParams", "Subtract", "Target", "Transform",
    "fit_standard_scaler",
]
