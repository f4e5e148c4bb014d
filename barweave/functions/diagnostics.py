"""Shares of missing and valid values of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import is_inf, is_valid


def diagnostics(df: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """For each column c: c_null_rate, c_valid_rate, c_has_inf, c_has_nan; one row, or one a key.

    NaN is not null here, but not valid either. An empty table has rates 0 and no inf or NaN. One hash aggregate.
    """
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        for name, test in (("null_rate", x.isNull()), ("valid_rate", is_valid(x))):
            out.append(F.coalesce(F.avg(test.cast("double")), F.lit(0.0)).alias(f"{c}_{name}"))
        for name, test in (("has_inf", is_inf(x)), ("has_nan", F.coalesce(F.isnan(x), F.lit(False)))):
            out.append(F.coalesce(F.bool_or(test), F.lit(False)).alias(f"{c}_{name}"))
    return df.groupBy(*(key or [])).agg(*out) if key else df.agg(*out)
