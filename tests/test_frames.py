"""Over DataFrames: isolation of keys, order, chained levels, streams, sources, adapters, diagnostics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave import *  # noqa: F403
from barweave.functions import diagnostics, std_dev
from barweave.sources import bars_from_ticks, load_sample_bars, read_bars_csv, read_series, run_features_pipeline_pandas, run_targets_pipeline_pandas, write_series
from barweave.streaming import final_state

SPECS = [
    Sma("x", 4, ["sma"]), Ema("x", 3, ["ema"]), Kama("x", 4, ["kama"]), LogReturn("ema", 1, ["ret"]), Correlation(["x", "y"], 5, ["tau"], "kendall"),
    RollingZScore("sma", 3, ["z"]), Subtract(["x", "sma"], ["gap"]), ShannonEntropy("y", 6, ["h"]), LinearSlope(["y", "x"], 4, ["s", "r"]),
]


def data(n=120, keys=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        for t in range(n):
            x = None if rng.random() < 0.05 else float(np.round(rng.normal(10, 2), 2))
            y = None if rng.random() < 0.03 else float("nan") if rng.random() < 0.03 else float(rng.integers(0, 5))
            rows.append((f"k{k}", t, x, y, f"note{t}"))
    rng.shuffle(rows)
    return [(r[0], int(r[1]), None if r[2] is None else float(r[2]), None if r[3] is None else float(r[3]), r[4]) for r in rows]


SCHEMA = "k string, t int, x double, y double, note string"


def local(rows, pipeline):
    out = {}
    for k in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for r, o in zip(own, pipeline.run_research([[r[2], r[3]] for r in own])):
            out[k, r[1]] = o
    return out


def same(a, b):
    np.testing.assert_allclose(np.array([math.nan if v is None else v for v in a], float), np.array(b, float), rtol=1e-9, atol=1e-9)


def test_batch_equals_one_series_at_a_time(spark):
    rows, p = data(), FeaturePipeline(SPECS, ["x", "y"])
    want = local(rows, p)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = p.transform(df, "k", "t").collect()
    assert len(got) == len(rows)
    assert got[0].__fields__ == ["k", "t", "x", "y", "note", *p.output_names()]
    for r in got:
        same([r[n] for n in p.output_names()], want[r["k"], r["t"]])
    bare = p.transform(df, "k", "t", keep_input=False)
    assert bare.columns == ["k", "t", *p.output_names()]


def test_arrow_batches_do_not_matter(spark):
    rows, p = data(90, 2), FeaturePipeline([Ema("x", 3, ["e"]), Adf("x", 12, ["s", "p"], lags=0)], ["x", "y"])
    want = local(rows, p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = p.transform(spark.createDataFrame(rows, SCHEMA), "k", "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in got:
        same([r[n] for n in p.output_names()], want[r["k"], r["t"]])


def test_wide_frames_go_to_kernels(spark):
    rows, specs = data(160, 2), [Sma("x", 40, ["a"]), RollingZScore("a", 40, ["b"]), Mma("y", 9, ["m"]), LinearSlope(["y", "x"], 17, ["s", "r"]), SimpleReturn("x", 90, ["q"])]
    p = FeaturePipeline(specs, ["x", "y"])
    assert [f.native for f in p.dag.features] == [False, False, False, True, False]
    want = local(rows, p)
    for r in p.transform(spark.createDataFrame(rows, SCHEMA), "k", "t").collect():
        same([r[n] for n in p.output_names()], want[r["k"], r["t"]])


def test_one_shuffle_and_no_key(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    p = FeaturePipeline(SPECS, ["x", "y"])
    plan = p.transform(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    native = FeaturePipeline([Sma("x", 4, ["a"]), RollingZScore("a", 3, ["b"])], ["x"]).transform(df, "k", "t")
    text = native._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Python" not in text and "Arrow" not in text
    one = [r for r in data() if r[0] == "k0"]
    got = p.transform(spark.createDataFrame(one, SCHEMA), [], "t").collect()
    want = local(one, p)
    for r in got:
        same([r[n] for n in p.output_names()], want["k0", r["t"]])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_spread_over_ranges(spark, parts):
    specs = [s for s in SPECS if not isinstance(s, (Ema, Kama, LogReturn))]
    rows, p = data(70, 3), FeaturePipeline(specs, ["x", "y"])
    want = local(rows, p)
    df = spark.createDataFrame(rows, SCHEMA)
    got = p.transform_spread(df, "k", "t", parts).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "t", "x", "y", "note", *p.output_names()]
    for r in got:
        same([r[n] for n in p.output_names()], want[r["k"], r["t"]])
    one = [r for r in rows if r[0] == "k1"]
    for r in p.transform_spread(spark.createDataFrame(one, SCHEMA), [], "t", parts, keep_input=False).collect():
        same([r[n] for n in p.output_names()], want["k1", r["t"]])
    assert p.transform_spread(df.limit(0), "k", "t", parts).collect() == []
    with pytest.raises(InvalidConfigError):
        FeaturePipeline([Ema("x", 3, ["e"])], ["x"]).transform_spread(df, "k", "t")


def test_empty_null_keys_and_overwrite(spark):
    p = FeaturePipeline([Ema("x", 2, ["e"]), Sma("x", 2, ["m"])], ["x"])
    assert p.transform(spark.createDataFrame([], SCHEMA), "k", "t").collect() == []
    rows = [(None, 1, 1.0, 0.0, ""), (None, 2, 3.0, 0.0, ""), ("a", 1, 5.0, 0.0, ""), ("a", 2, 7.0, 0.0, "")]
    got = {(r["k"], r["t"]): (r["e"], r["m"]) for r in p.transform(spark.createDataFrame(rows, SCHEMA), "k", "t").collect()}
    assert got == {(None, 1): (None, None), (None, 2): (2.0, 2.0), ("a", 1): (None, None), ("a", 2): (6.0, 6.0)}
    over = FeaturePipeline([Sma("x", 2, ["x"]), Subtract(["x", "y"], ["d"])], ["x", "y"]).transform(spark.createDataFrame(rows, SCHEMA), "k", "t")
    assert sorted((r["k"] or "", r["t"], r["x"], r["d"]) for r in over.collect())[3] == ("a", 2, 6.0, 6.0)
    with pytest.raises(MissingInputColumnError):
        p.transform(spark.createDataFrame(rows, SCHEMA).drop("x"), "k", "t")


def test_targets(spark):
    rows = data()
    t = TargetPipeline([FutureReturn("x", 2, ["a"]), FutureCTCVolatility("x", 3), FutureLinearSlope(["y", "x"], 3, ["s", "r"])], ["x", "y"])
    got = {(r["k"], r["t"]): r for r in t.transform(spark.createDataFrame(rows, SCHEMA), "k", "t").collect()}
    for k in ("k0", "k1", "k2"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for name, column in zip(t.output_names(), t.run_research([[r[2] for r in own], [r[3] for r in own]])):
            same([got[k, r[1]][name] for r in own], column)


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_equals_batch(spark, tmp_path, cuts):
    rows, p = data(60, 2), FeaturePipeline(SPECS, ["x", "y"])
    want = local(rows, p)
    src = str(tmp_path / "in")
    bounds = np.linspace(0, 60, cuts + 1).astype(int)
    for a, b in zip(bounds, bounds[1:]):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = p.transform_stream(stream, "k", "t")
    q = out.writeStream.format("memory").queryName(f"live{cuts}").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = spark.table(f"live{cuts}").collect()
    finally:
        q.stop()
    assert len(got) == len(rows)
    for r in got:
        same([r[n] for n in p.output_names()], want[r["k"], r["t"]])
    with pytest.raises(InvalidConfigError):
        TargetPipeline([FutureReturn("x", 2, ["a"])], ["x"]).transform(stream, "k", "t")


def test_stream_goes_on_from_a_batch_and_drops_late_rows(spark, tmp_path):
    rows, p = data(60, 2), FeaturePipeline([Ema("x", 3, ["e"]), Sma("x", 4, ["m"])], ["x", "y"])
    want = local(rows, p)
    old = spark.createDataFrame([r for r in rows if r[1] < 40], SCHEMA)
    src = str(tmp_path / "in")
    spark.createDataFrame([r for r in rows if r[1] >= 38], SCHEMA).coalesce(1).write.parquet(src)
    out = p.transform_stream(spark.readStream.schema(SCHEMA).parquet(src), "k", "t", initial=final_state(p, old, "k", "t"))
    q = out.writeStream.format("memory").queryName("warm").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = spark.table("warm").collect()
    finally:
        q.stop()
    assert sorted((r["k"], r["t"]) for r in got) == [(k, t) for k in ("k0", "k1") for t in range(40, 60)]
    for r in got:
        same([r["e"], r["m"]], want[r["k"], r["t"]])


def test_bars_and_files(spark, tmp_path):
    ticks = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0), ("a", 50, 2.0), ("a", 61, None), ("b", 5, 7.0), ("a", 130, 4.0)], "k string, s int, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    got = [(r["k"], r["time"].minute, r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars_from_ticks(ticks, "k", "ts", "v", "1 minute").orderBy("k", "time").collect()]
    assert got == [("a", 0, 1.0, 3.0, 1.0, 2.0, 3.0), ("a", 2, 4.0, 4.0, 4.0, 4.0, 1.0), ("b", 0, 7.0, 7.0, 7.0, 7.0, 1.0)]
    sample = load_sample_bars(spark, 50)
    assert sample.filter("high < low or high < open or low > close or volume <= 0").count() == 0 and sample.count() == 50
    path = str(tmp_path / "bars")
    sample.write.option("header", True).csv(path)
    assert read_bars_csv(spark, path).agg(F.round(F.sum("close"), 6)).first() == sample.agg(F.round(F.sum("close"), 6)).first()
    write_series(sample, str(tmp_path / "p"), partition_by=[])
    assert read_series(spark, str(tmp_path / "p")).count() == 50


def test_pandas_adapters():
    df = pd.DataFrame({"x": [1.0, 2.0, np.nan, 4.0, 5.0, 6.0], "other": 0}, index=list("abcdef"))
    f = run_features_pipeline_pandas(FeaturePipeline([Sma("x", 2, ["m"])], ["x"]), df)
    assert list(f.index) == list("abcdef") and list(f.columns) == ["m"]
    np.testing.assert_allclose(f["m"], [np.nan, 1.5, np.nan, np.nan, 4.5, 5.5])
    t = run_targets_pipeline_pandas(TargetPipeline([FutureReturn("x", 1, ["r"])], ["x"]), df)
    np.testing.assert_allclose(t["r"], [1, np.nan, np.nan, 0.25, 0.2, np.nan])


def test_diagnostics(spark):
    df = spark.createDataFrame([(None,), (None,), (1.0,), (2.0,), (float("inf"),), (None,)], "x double")
    r = diagnostics(df, ["x"]).first()
    assert (r["x_null_rate"], r["x_has_inf"], r["x_has_nan"]) == (0.5, True, False) and abs(r["x_valid_rate"] - 2 / 6) < 1e-12
    assert tuple(diagnostics(df.limit(0), ["x"]).first()) == (0.0, 0.0, False, False)
    assert df.agg(std_dev(F.col("x")).alias("s")).first()["s"] is None
