"""Pipelines over local pandas and polars tables of one series; only the outputs come back."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..errors import MissingInputColumnError
from ..plans.pipeline import FeaturePipeline, TargetPipeline


def _checked(pipeline, columns) -> None:
    missing = [n for n in pipeline.input_names() if n not in list(columns)]
    if missing:
        raise MissingInputColumnError(f"the table has no column {missing!r}")


def run_features_pipeline_pandas(pipeline: FeaturePipeline, df: pd.DataFrame) -> pd.DataFrame:
    """The outputs for each row, on the same index; NaN for no value. Runs here, without Spark."""
    _checked(pipeline, df.columns)
    rows = df[pipeline.input_names()].to_numpy(float, na_value=np.nan).tolist()
    return pd.DataFrame(pipeline.run_research(rows), index=df.index, columns=pipeline.output_names(), dtype=float)


def run_targets_pipeline_pandas(pipeline: TargetPipeline, df: pd.DataFrame) -> pd.DataFrame:
    """The targets for each row, on the same index."""
    _checked(pipeline, df.columns)
    columns = [df[n].to_numpy(float, na_value=np.nan) for n in pipeline.input_names()]
    return pd.DataFrame(dict(zip(pipeline.output_names(), pipeline.run_research(columns))), index=df.index, dtype=float)


def run_features_pipeline_polars(pipeline: FeaturePipeline, df):
    import polars as pl

    out = run_features_pipeline_pandas(pipeline, _from_polars(pipeline, df))
    return pl.DataFrame({c: out[c].to_numpy() for c in out})


def run_targets_pipeline_polars(pipeline: TargetPipeline, df):
    import polars as pl

    out = run_targets_pipeline_pandas(pipeline, _from_polars(pipeline, df))
    return pl.DataFrame({c: out[c].to_numpy() for c in out})


def _from_polars(pipeline, df) -> pd.DataFrame:
    _checked(pipeline, df.columns)
    return pd.DataFrame({n: np.array([np.nan if v is None else v for v in df[n].to_list()], float) for n in pipeline.input_names()})
