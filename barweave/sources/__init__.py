"""Readers and writers of bars, ticks to bars, sample data, and pandas/polars adapters."""

from .adapters import run_features_pipeline_pandas, run_features_pipeline_polars, run_targets_pipeline_pandas, run_targets_pipeline_polars
from .bars import BARS_SCHEMA, bars_from_ticks, load_sample_bars, read_bars_csv, read_series, stream_bars, stream_series, write_series

__all__ = [
    "BARS_SCHEMA", "bars_from_ticks", "load_sample_bars", "read_bars_csv", "read_series", "run_features_pipeline_pandas",
    "run_features_pipeline_polars", "run_targets_pipeline_pandas", "run_targets_pipeline_polars", "stream_bars", "stream_series", "write_series",
]
