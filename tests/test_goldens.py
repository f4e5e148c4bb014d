"""Hand-computed and published values, on the kernels and on the window plans."""

import math

import numpy as np
import pytest

from barweave import *  # noqa: F403
from barweave.operators.stationarity import p_value

N = None
NAN = float("nan")
REF_X = [0.0000, 0.5087, -0.1558, 0.2507, 0.8633, 0.3085, 0.5017, 0.4578, -0.2826, 0.1437, 0.4694, -0.0066, 0.2960, 0.6133, -0.1088, 0.3521, 0.3786, 0.1477, 0.5707, 0.1324]
PRICES = [100, 102, 105, 103, 108, 107, 110]
ENTROPY = [1, 2, 1.5, 3, 2.5, 1, 4, 3.5, 2, 1.5, 2, 3]
E = math.e
RS = math.sqrt(math.log(108 / 107) * math.log(108 / 105) + math.log(104 / 107) * math.log(104 / 105))

FEATURES = [
    (Sma("x", 3, ["o"]), [[1, 2, 3, N, 4, 5, 6]], [[N, N, 2, N, N, N, 5]]),
    (Sma("x", 3, ["o"]), [[100, 101, 102, 103, N, 104, 105, 106]], [[N, N, 101, 102, N, N, N, 105]]),
    (Mma("x", 3, ["o"]), [[1, 3, 2, 2, 5, 3]], [[N, N, 2, 2, 2, 3]]),
    (Mma("x", 3, ["o"]), [[1, 3, 2, N, 5, 3, 2]], [[N, N, 2, N, N, N, 3]]),
    (Mma("x", 6, ["o"]), [[6, 3, 2, 1, 4, 5]], [[N, N, N, N, N, 3.5]]),
    (Ema("x", 3, ["o"]), [[100, 200, 300, 400, 500]], [[N, N, 200, 300, 400]]),
    (Ema("x", 3, ["o"]), [[100, N, 200, 300, 400]], [[N, N, N, N, 300]]),
    (Ema("x", 3, ["o"]), [[100, 200, 300, N, 100, 200, 300]], [[N, N, 200, N, N, N, 200]]),
    (Kama("x", 3, ["o"], fast=2, slow=5), [[100, 101, 103, 102, 105, 107, 106]], [[N, N, N, 102.75, 103.44444444444444, 104.54183813443072, 104.99188809293976]]),
    (SimpleReturn("x", 2, ["o"]), [[100, 100, N, 110, 115, 120]], [[N, N, N, 0.1, N, 10 / 110]]),
    (SimpleReturn("x", 1, ["o"]), [[100, 90]], [[N, -0.1]]),
    (LogReturn("x", 2, ["o"]), [[E, E, N, E**1.2, E**1.3, E**1.4]], [[N, N, N, 0.2, N, 0.2]]),
    (Skewness("x", 3, ["o"]), [[1, 2, 4, 6]], [[N, N, 0.935219529582824, 0]]),
    (Skewness("x", 8, ["o"]), [[2, 4, 4, 4, 5, 5, 7, 9]], [[N] * 7 + [0.818487553356800]]),
    (Skewness("x", 5, ["o"]), [[1, 1, 1, 2, 10]], [[N] * 4 + [2.171292493874224]]),
    (Kurtosis("x", 4, ["o"]), [[1, 2, 4, 8]], [[N, N, N, 0.757655954631380]]),
    (Kurtosis("x", 8, ["o"]), [[2, 4, 4, 4, 5, 5, 7, 9]], [[N] * 7 + [0.940625]]),
    (Kurtosis("x", 5, ["o"]), [[1, 2, 3, 4, 5]], [[N] * 4 + [-1.2]]),
    (Skewness("x", 3, ["o"]), [[5, 5, 5]], [[N, N, N]]),
    (Kurtosis("x", 4, ["o"]), [[0.1, 0.1, 0.1, 0.1]], [[N] * 4]),
    (LinearSlope(["x", "y"], 3, ["s", "r"]), [[1, 2, 3], [2.1, 3.9, 6.2]], [[N, N, 2.05], [N, N, 151.29 / 152.04]]),
    (LinearSlope(["x", "y"], 3, ["s", "r"]), [[1, 2, 3], [5, 5, 5]], [[N, N, 0], [N, N, N]]),
    (LinearSlope(["x", "y"], 3, ["s", "r"]), [[5, 5, 5], [1, 2, 3]], [[N, N, N], [N, N, N]]),
    (ParkinsonVolatility(["x", "y"], 3, ["o"]), [[102, 104, 103, 106, 108], [99, 101, 100, 103, 105]], [[N, N, 0.017753593761606, 0.017525511477570, 0.017307528183468]]),
    (ParkinsonVolatility(["x", "y"], 1, ["o"]), [[99], [105]], [[N]]),
    (RogersSatchellVolatility(["x", "y", "z", "u"], 3, ["o"]), [[108] * 3, [104] * 3, [105] * 3, [107] * 3], [[N, N, RS]]),
    (RogersSatchellVolatility(["x", "y", "z", "u"], 3, ["o"]), [[100] * 3] * 4, [[N, N, 0.0]]),
    (ShannonEntropy("x", 10, ["o"], bins=2, normalize=False), [ENTROPY], [[N] * 9 + [0.6730116670092565, 0.6730116670092565, math.log(2)]]),
    (ShannonEntropy("x", 4, ["o"]), [[5, 5, 5, 5]], [[N, N, N, 0.0]]),
    (Correlation(["x", "y"], 3, ["o"]), [[1, 2, 3], [1, 3, 2]], [[N, N, 0.5]]),
    (Correlation(["x", "y"], 3, ["o"]), [[0.1, 0.1, 0.1], [1, 3, 2]], [[N, N, N]]),
    (Correlation(["x", "y"], 4, ["o"], "spearman"), [[1, 2, 3, 4], [1, 3, 2, 4]], [[N, N, N, 0.8]]),
    (Correlation(["x", "y"], 4, ["o"], "spearman"), [[1, 1, 3, 4], [1, 2, 3, 4]], [[N, N, N, 4.5 / math.sqrt(22.5)]]),
    (Correlation(["x", "y"], 4, ["o"], "kendall"), [[1, 2, 3, 4], [1, 3, 2, 4]], [[N, N, N, 2 / 3]]),
    (Correlation(["x", "y"], 4, ["o"], "kendall"), [[1, 1, 2, 3], [1, 2, 3, 4]], [[N, N, N, 5 / math.sqrt(30)]]),
    (AutoCorrelation("x", 3, ["o"]), [[1, 3, 2, 4]], [[N, N, N, -0.5]]),
    (AutoCorrelation("x", 3, ["o"], lag=2), [[1, 2, 3, 4, 5]], [[N, N, N, N, 1]]),
    (RollingZScore("x", 3, ["o"]), [[1, 2, 3, N, 5, 6, 7]], [[N, N, 1, N, N, N, 1]]),
    (RollingZScore("x", 3, ["o"]), [[0.1, 0.1, 0.1]], [[N, N, N]]),
    (FixedZScore("x", ["o"], mean=3, std=2), [[5, 3, 1, N]], [[1, 0, -1, N]]),
    (Add(["x", "y"], ["o"]), [[1, N, 3], [2, 2, N]], [[3, N, N]]),
    (Subtract(["x", "y"], ["o"]), [[1, float("inf")], [2, float("inf")]], [[-1, N]]),
    (Multiply(["x", "y"], ["o"]), [[3, N], [2, 1]], [[6, N]]),
    (Divide(["x", "y"], ["o"]), [[1, 1, 1, N], [2, 0, -0.0, 1]], [[0.5, N, N, N]]),
    (Reciprocal("x", ["o"]), [[4, 0, -0.0, N]], [[0.25, N, N, N]]),
    (Log("x", ["o"]), [[E, 0, -1, N, NAN]], [[1, N, N, N, N]]),
    (NegLog("x", ["o"]), [[E, 0, -1, N]], [[-1, N, N, N]]),
    (Logit("x", ["o"]), [[0.5, 0, 1, -1, 2, N, 0.75]], [[0, N, N, N, N, N, math.log(3)]]),
]
TARGETS = [
    (FutureReturn("x", 2, ["o"]), [PRICES], [[0.05, 1 / 102, 3 / 105, 4 / 103, 2 / 108, N, N]]),
    (FutureCTCVolatility("x", 3), [[100, 101, 103, 102, 105, 107, 106]], [[0.014966120092234598, 0.020212720949768705, 0.02009494773792543, 0.019890273555006756, N, N, N]]),
    (FutureLinearSlope(["x", "y"], 3, ["s", "r"]), [[0, 1, 2, 3, 4], [1, 1, 1, 1, 1]], [[0, 0, 0, N, N], [N] * 5]),
    (FutureLinearSlope(["x", "y"], 3, ["s", "r"]), [[2, 2, 2], [1, 2, 3]], [[N] * 3, [N] * 3]),
]
for lags, c, ct in ((0, -5.656496589965162, -5.465768323608186), (2, -2.124282684987995, -2.1282576700330598)):
    for kind, stat in (("c", c), ("ct", ct)):
        FEATURES.append((Adf("x", 20, ["s", "p"], lags=lags, regression=kind), [REF_X], [[N] * 19 + [stat], [N] * 19 + [float(p_value(np.array([stat]), kind)[0])]]))
FEATURES += [
    (Adf("x", 20, ["s", "p"], lags=0), [[5] * 20], [[N] * 20] * 2),
    (Adf("x", 20, ["s", "p"], lags=2, regression="ct"), [list(range(20))], [[N] * 20] * 2),
]


def close(got, want, tol=1e-9):
    got, want = np.array([NAN if v is None else v for v in got], float), np.array([NAN if v is None else v for v in want], float)
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol)


@pytest.mark.parametrize("spec,columns,want", FEATURES, ids=lambda v: repr(v)[:60])
def test_kernel(spec, columns, want):
    rows = list(zip(*columns))
    out = FeaturePipeline([spec], spec.input_names()).run_research(rows)
    for got, w in zip(zip(*out), want):
        close(got, w)
    spec.reset()
    for r, o in zip(rows, out):
        close(spec.update(list(r)), o, 1e-12)
    spec.reset()


def frame(spark, names, columns, key="a"):
    rows = [(key, i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, ", ".join(["k string", "t int", *[f"{n} double" for n in names]]))


def test_batch_plans(spark):
    """All golden rows in two jobs: window plans and Arrow pass give what the kernels do."""
    for group, pipeline in ((FEATURES, FeaturePipeline), (TARGETS, TargetPipeline)):
        frames = []
        for i, (spec, columns, want) in enumerate(group):
            names = spec.input_names()
            made = pipeline([spec], names).transform(frame(spark, names, columns, str(i)), "k", "t", keep_input=False)
            outs = spec.output_names()
            frames.append(made.selectExpr("k", "t", f"{outs[0]} AS a", f"{outs[1] if len(outs) > 1 else outs[0]} AS b"))
        for i, f in enumerate(frames):
            got = f.orderBy("t").collect()
            want = group[i][2]
            close([r["a"] for r in got], want[0])
            close([r["b"] for r in got], want[-1])


@pytest.mark.parametrize("spec,columns,want", TARGETS, ids=lambda v: repr(v)[:60])
def test_local_targets(spec, columns, want):
    for got, w in zip(spec.run_research(columns), want):
        close(got, w)


@pytest.mark.parametrize("stat,kind,want", [(-10, "c", 1.6661204834e-07), (5, "c", 1), (-3.0, "c", 3.4894400275e-02), (-2.9, "c", (3.4894400275e-02 + 5.8273768069e-02) / 2), (-3.0, "ct", 1.3208098478e-01), (1.5, "ct", 1)])
def test_p_value(stat, kind, want):
    assert abs(p_value(np.array([stat]), kind)[0] - want) < 1e-12


def test_defaults():
    assert ShannonEntropy("x", 4, ["o"]).bin_count() == 3
    assert ShannonEntropy("x", 10, ["o"]).bin_count() == 5
    assert Adf("x", 100, ["s", "p"]).lag_count() == 12


def test_scaler(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, None)], "x double")
    close(fit_standard_scaler(df, "x"), (3, math.sqrt(2.5)))
    close(fit_standard_scaler([1, None, 3, NAN, 5]), (3, 2))
    for bad in ([1.0], [2.0, 2.0], [None, None]):
        with pytest.raises(InvalidInputError):
            fit_standard_scaler(bad)
        with pytest.raises(InvalidInputError):
            fit_standard_scaler(spark.createDataFrame([(v,) for v in bad], "x double"), "x")
