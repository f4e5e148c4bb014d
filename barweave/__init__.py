"""Rolling features, operators, scalers and targets over ordered series, on Spark."""

from .errors import (
    CyclicDependencyError,
    DuplicateOutputKeyError,
    EngineError,
    InvalidConfigError,
    InvalidInputError,
    MissingInputColumnError,
)
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import FeatureDag, FeaturePipeline, SeriesRunner, TargetPipeline

__version__ = "0.1.0"
__all__ = [
    *_operators,
    "CyclicDependencyError", "DuplicateOutputKeyError", "EngineError", "FeatureDag", "FeaturePipeline", "InvalidConfigError",
    "InvalidInputError", "MissingInputColumnError", "SeriesRunner", "TargetPipeline",
]
