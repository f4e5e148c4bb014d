"""Dependency resolution and the two pipelines."""

from .dag import FeatureDag
from .pipeline import FeaturePipeline, TargetPipeline
from .runner import SeriesRunner

__all__ = ["FeatureDag", "FeaturePipeline", "SeriesRunner", "TargetPipeline"]
