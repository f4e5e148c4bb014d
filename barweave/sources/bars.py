"""Where series come from and go to: files through Spark's readers and writers, ticks as time bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS_SCHEMA = "time timestamp, open double, high double, low double, close double, volume double"


def read_bars_csv(spark: SparkSession, path: str, schema: str = BARS_SCHEMA, header: bool = True) -> DataFrame:
    """Bars of CSV files by an explicit schema (no pass over the data to guess one)."""
    return spark.read.csv(path, schema=schema, header=header)


def read_series(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of any format that the session can read; filters and columns are pushed down by Spark."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def stream_series(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> DataFrame:
    """A stream of the files that arrive under a path."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def write_series(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", **options) -> None:
    """Write a table, or for a stream start nothing: use `df.writeStream` with a checkpoint there."""
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _bar_columns(value: str, order: list[str]):
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return [
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, at).alias("close"), F.count(value).cast("double").alias("volume"),
    ]


def bars_from_ticks(df: DataFrame, key: str | Sequence[str], time: str, value: str, width: str, tie_breaker: str | None = None) -> DataFrame:
    """One bar per key and time bucket of `width` (such as '1 hour'): time, open, high, low, close, volume (ticks).

    Null values are left out; a bucket without values has no bar. Partial aggregates are formed before the one
    shuffle, so a hot key costs no more than its number of bars.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [time, *([tie_breaker] if tie_breaker else [])]
    bucket = F.window(F.col(time), width)["start"].alias("time")
    return df.filter(F.col(value).isNotNull()).groupBy(*key, bucket).agg(*_bar_columns(value, order))


def stream_bars(df: DataFrame, key: str | Sequence[str], time: str, value: str, width: str, delay: str) -> DataFrame:
    """The same on a stream: a bar comes out when the watermark passes its end; later ticks are dropped."""
    key = [key] if isinstance(key, str) else list(key)
    late = df.filter(F.col(value).isNotNull()).withWatermark(time, delay)
    return late.groupBy(*key, F.window(F.col(time), width).alias("w")).agg(*_bar_columns(value, [time])).select(*key, F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def load_sample_bars(spark: SparkSession, rows: int = 14000) -> DataFrame:
    """Deterministic hourly sample bars, made by a rule (a drift, two cycles and hashed noise)."""

    def noise(salt: int):
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(100000)) / 100000.0

    def price(t):
        return 100 + t * 0.002 + 5 * F.sin(t / 170.0) + 2 * F.sin(t / 23.0)

    t = F.col("id").cast("double")
    bars = spark.range(rows).select(
        F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 3600).alias("time"),
        (price(t) + noise(1)).alias("open"), (price(t + 1) + noise(2)).alias("close"),
        noise(3).alias("up"), noise(4).alias("down"), (1000 + 9000 * noise(5)).alias("volume"),
    )
    return bars.select("time", "open", (F.greatest("open", "close") + F.col("up")).alias("high"), (F.least("open", "close") - F.col("down")).alias("low"), "close", "volume")
