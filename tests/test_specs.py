"""Validation, names, warm-up and dependency order."""

import pytest

from barweave import *  # noqa: F403

X, O = ["x"], ["o"]


@pytest.mark.parametrize(
    "make,error",
    [
        (lambda: Sma(X, 0, O), InvalidInputError),
        (lambda: Sma(X, -1, O), InvalidInputError),
        (lambda: Sma(X, 2.5, O), InvalidInputError),
        (lambda: Sma([], 3, O), InvalidInputError),
        (lambda: Sma(X, 3, []), InvalidInputError),
        (lambda: Sma(X, 3, ["a", "b"]), InvalidInputError),
        (lambda: Skewness(X, 2, O), InvalidInputError),
        (lambda: Kurtosis(X, 3, O), InvalidInputError),
        (lambda: ShannonEntropy(X, 1, O), InvalidInputError),
        (lambda: ShannonEntropy(X, 4, O, bins=1), InvalidInputError),
        (lambda: Correlation(["x", "y"], 1, O), InvalidInputError),
        (lambda: Correlation(X, 3, O), InvalidInputError),
        (lambda: Correlation(["x", "y"], 3, O, "cosine"), InvalidConfigError),
        (lambda: AutoCorrelation(X, 3, O, lag=0), InvalidInputError),
        (lambda: Adf(X, 20, ["s", "p"], regression="n"), InvalidConfigError),
        (lambda: Adf(X, 13, ["s", "p"], lags=5), InvalidInputError),
        (lambda: Adf(X, 17, ["s", "p"]), InvalidInputError),
        (lambda: Kama(X, 3, O, fast=5, slow=5), InvalidInputError),
        (lambda: Kama(X, 3, O, fast=0), InvalidInputError),
        (lambda: LinearSlope(["x", "y"], 3, O), InvalidInputError),
        (lambda: LinearSlope(["x", "y"], 1, ["s", "r"]), InvalidInputError),
        (lambda: RollingZScore(X, 1, O), InvalidInputError),
        (lambda: FixedZScore(X, O, 0.0, 0.0), InvalidInputError),
        (lambda: FixedZScore(X, O, 0.0, float("nan")), InvalidInputError),
        (lambda: Add(X, O), InvalidInputError),
        (lambda: Log(["x", "y"], O), InvalidInputError),
        (lambda: FutureReturn(X, 0, O), InvalidInputError),
        (lambda: FutureCTCVolatility("x", 1), InvalidInputError),
        (lambda: FutureLinearSlope(["x", "y"], 1, ["s", "r"]), InvalidInputError),
        (lambda: FeaturePipeline([], X), InvalidConfigError),
        (lambda: FeaturePipeline([Sma(X, 3, O)], ["x", "x"]), InvalidConfigError),
        (lambda: FeaturePipeline([Sma(["q"], 3, O)], X), MissingInputColumnError),
        (lambda: FeaturePipeline([Sma(["o"], 3, O)], X), MissingInputColumnError),
        (lambda: FeaturePipeline([object()], X), InvalidConfigError),
        (lambda: FeaturePipeline([FutureReturn(X, 1, O)], X), InvalidConfigError),
        (lambda: FeaturePipeline([Sma(X, 3, O), Mma(X, 3, O)], X), DuplicateOutputKeyError),
        (lambda: FeaturePipeline([Sma(["b"], 2, ["a"]), Sma(["a"], 2, ["b"])], X), CyclicDependencyError),
        (lambda: TargetPipeline([], X), InvalidConfigError),
        (lambda: TargetPipeline([FutureReturn(X, 1, O), FutureReturn(X, 2, O)], X), DuplicateOutputKeyError),
        (lambda: TargetPipeline([FutureReturn("q", 1, O)], X), MissingInputColumnError),
        (lambda: TargetPipeline([Sma(X, 3, O)], X), InvalidConfigError),
        (lambda: FeaturePipeline([Sma(X, 3, O)], X).update([1.0, 2.0]), InvalidInputError),
    ],
)
def test_errors(make, error):
    with pytest.raises(error):
        make()


def test_errors_are_value_errors():
    assert issubclass(InvalidInputError, EngineError) and not issubclass(EngineError, ValueError)


@pytest.mark.parametrize(
    "spec,warm",
    [(Sma(X, 3, O), 2), (Mma(X, 3, O), 2), (Ema(X, 3, O), 2), (Kama(X, 3, O), 3), (SimpleReturn(X, 3, O), 3), (LogReturn(X, 3, O), 3), (Skewness(X, 3, O), 2), (Kurtosis(X, 4, O), 3), (LinearSlope(["x", "y"], 3, ["s", "r"]), 2), (Correlation(["x", "y"], 3, O), 2), (AutoCorrelation(X, 3, O, lag=2), 4), (ShannonEntropy(X, 4, O), 3), (Adf(X, 20, ["s", "p"], lags=0), 19), (RollingZScore(X, 3, O), 2), (FixedZScore(X, O), 0), (Log(X, O), 0)],
)
def test_warm_up_is_the_null_prefix(spec, warm):
    assert spec.warm_up_period() == warm
    rows = [[1 + 0.1 * ((i * 7) % 5), 2 + 0.1 * ((i * 11) % 7)][: len(spec.inputs)] for i in range(warm + 6)]
    out = FeaturePipeline([spec], spec.input_names()).run_research(rows)
    assert [o[0] != o[0] for o in out] == [True] * warm + [False] * 6
    assert len(out[0]) == len(spec.output_names())


def test_order_and_periods():
    features = [RollingZScore("r", 4, ["z"]), Sma("x", 3, ["m"]), LogReturn("m", 1, ["r"]), Subtract(["x", "m"], ["gap"])]
    p = FeaturePipeline(features, X)
    assert p.output_names() == ["m", "r", "gap", "z"]
    assert (p.warm_up_period(), p.effective_warm_up(), len(p)) == (3, 6, 4)
    assert [len(level) for level in p.dag.levels()] == [1, 2, 1]
    t = TargetPipeline([FutureReturn("x", 2, ["a"]), FutureCTCVolatility("x", 5)], X)
    assert (t.output_names(), t.forward_period(), t.warm_up_period()) == (["a", "x_future_ctc_vol_5"], 5, 0)


def test_pipeline_does_not_share_state():
    s = Sma("x", 2, O)
    p = FeaturePipeline([s], X)
    s.update([1.0])
    assert p.update([2.0])[0] != p.update([2.0])[0]
    assert s.update([3.0]) == [2.0]
    assert "Sma(inputs=('x',)" in repr(s)


def test_research_then_live():
    p = FeaturePipeline([Sma("x", 3, O), Ema("x", 3, ["e"])], X)
    whole = p.run_research([[float(i * i % 7)] for i in range(20)])
    p.run_research([[float(i * i % 7)] for i in range(12)])
    assert [p.update([float(i * i % 7)]) for i in range(12, 20)] == whole[12:]


def test_chain_golden():
    p = FeaturePipeline([Sma("x", 3, ["m"]), LogReturn("m", 1, ["r"])], X)
    out = p.run_research([[100], [101], [102], [103], [104]])
    assert [round(o[0], 4) for o in out[2:]] == [101, 102, 103]
    assert [round(o[1], 4) for o in out[3:]] == [0.0099, 0.0098]
    assert all(o[1] != o[1] for o in out[:3])


def test_order_of_outputs():
    """A feature comes where the last one that it reads from comes, so C, which waits for B, is behind D, which waits for A."""
    a, b, c, d = Sma("x", 2, ["a"]), Sma("x", 3, ["b"]), Sma("b", 2, ["c"]), Sma("a", 2, ["d"])
    assert FeaturePipeline([a, b, c, d], ["x"]).output_names() == ["a", "b", "d", "c"]
    assert FeaturePipeline([c, d, b, a], ["x"]).output_names() == ["b", "a", "c", "d"]
    both = Add(["d", "b"], ["e"])
    assert FeaturePipeline([both, a, b, c, d], ["x"]).output_names() == ["a", "b", "d", "c", "e"]


def test_polars_adapters(monkeypatch):
    """The adapters use nothing of polars but what this stand-in has."""
    import sys
    import types

    import pandas as pd

    from barweave.sources import run_features_pipeline_pandas, run_features_pipeline_polars, run_targets_pipeline_pandas, run_targets_pipeline_polars

    class Frame:
        def __init__(self, data):
            self.data = {k: list(v) for k, v in data.items()}
            self.columns = list(data)

        def __getitem__(self, name):
            return types.SimpleNamespace(to_list=lambda: self.data[name])

    monkeypatch.setitem(sys.modules, "polars", types.SimpleNamespace(DataFrame=Frame))
    x = [1.0, 2.0, None, 4.0, 5.0, 7.0]
    table, same = Frame({"x": x, "other": [0] * 6}), pd.DataFrame({"x": x})
    features, targets = FeaturePipeline([Sma("x", 2, ["m"]), LogReturn("m", 1, ["r"])], ["x"]), TargetPipeline([FutureReturn("x", 1, ["f"])], ["x"])
    for got, want in ((run_features_pipeline_polars(features, table), run_features_pipeline_pandas(features, same)), (run_targets_pipeline_polars(targets, table), run_targets_pipeline_pandas(targets, same))):
        assert got.columns == list(want)
        assert all(a == b or a != a and b != b for c in got.columns for a, b in zip(got.data[c], want[c].tolist()))
    with pytest.raises(MissingInputColumnError):
        run_features_pipeline_polars(features, Frame({"other": [1]}))
