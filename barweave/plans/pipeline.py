"""Pipelines over DataFrames of many series.

A series is the rows of one key in the order of `order`, which must be unique inside a key (add a tie-breaker
column). Without a key the whole table is one series in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DuplicateOutputKeyError, InvalidConfigError, InvalidInputError, MissingInputColumnError
from ..functions.columns import clean
from ..operators.base import Target, Transform, local
from .dag import FeatureDag
from .runner import SeriesRunner


def window_order(key: Sequence[str], order: Sequence[str]):
    w = Window.orderBy(*order)
    return Window.partitionBy(*key).orderBy(*order) if key else w


def _named(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _unique_inputs(columns: list[str]) -> None:
    if len(set(columns)) < len(columns):
        raise InvalidConfigError(f"input columns repeat: {columns!r}")


def _planned(nodes, columns: dict[str, Column], order) -> tuple[dict[str, Column], list]:
    """(per-row terms, builders of outputs) of one level's nodes."""
    terms, builders = {}, []
    for k, node in enumerate(nodes):
        x = [columns[n] for n in node.input_names()]
        own = {f"__term_{k}_{j}": t for j, t in enumerate(node.prepare(x, order))}
        terms |= own
        builders.append((node, x, list(own)))
    return terms, builders


def _level(df: DataFrame, nodes, hidden: dict[str, str], order) -> DataFrame:
    """Add one level's outputs as columns; window terms first, in a projection of their own."""
    terms, builders = _planned(nodes, {n: F.col(h) for n, h in hidden.items()}, order)
    df = df.withColumns(terms) if terms else df
    out = {}
    for node, x, own in builders:
        for name, value in zip(node.output_names(), node.plan(x, [F.col(t) for t in own], order)):
            out[f"__out_{name}"] = clean(value)
    return df.withColumns(out).drop(*terms)


class FeaturePipeline:
    """Features over `input_columns`, chained by name."""

    def __init__(self, features: Sequence[Transform], input_columns: Sequence[str]):
        features, columns = list(features), list(input_columns)
        for f in features:
            if not isinstance(f, Transform):
                raise InvalidConfigError(f"{f!r} is no feature, operator or scaler")
        if not features:
            raise InvalidConfigError("a pipeline needs a feature")
        _unique_inputs(columns)
        self.dag = FeatureDag([f.fresh() for f in features])
        missing = [n for n in self.dag.required() if n not in columns]
        if missing:
            raise MissingInputColumnError(f"neither input nor output of a feature: {missing!r}")
        self.columns = columns
        self._live: SeriesRunner | None = None
        slow: set[int] = set()
        for i, f in enumerate(self.dag.features):
            # an overwritten input is seen only by later nodes, which the runner's order gives
            if not f.native or slow & set(self.dag.parents[i]):
                slow.add(i)
        self._slow = sorted(slow)

    def __len__(self) -> int:
        return len(self.dag.features)

    def __repr__(self) -> str:
        return f"FeaturePipeline({self.dag.features!r}, input_columns={self.columns!r})"

    def input_names(self) -> list[str]:
        return list(self.columns)

    def output_names(self) -> list[str]:
        return self.dag.output_names()

    def warm_up_period(self) -> int:
        """The largest warm-up of a single feature (chains can take longer: `effective_warm_up`)."""
        return max(f.warm_up_period() for f in self.dag.features)

    def effective_warm_up(self) -> int:
        return self.dag.effective_warm_up()

    # -- live, one bar at a time ---------------------------------------------------------------

    def update(self, bar: Sequence[float | None]) -> list[float]:
        """The outputs for one more bar of a single series; NaN for no value."""
        if len(bar) != len(self.columns):
            raise InvalidInputError(f"{len(self.columns)} values are needed, not {len(bar)}")
        self._live = self._live or SeriesRunner(self.dag)
        row = {n: np.array([np.nan if v is None else float(v)]) for n, v in zip(self.columns, bar)}
        out = self._live.step(row)
        return [float(out[n][0]) for n in self.output_names()]

    def reset(self) -> None:
        self._live = None

    def run_research(self, rows: Sequence[Sequence[float | None]]) -> list[list[float]]:
        """Reset, then the outputs for each bar; a following `update` goes on from the last one."""
        for r in rows:
            if len(r) != len(self.columns):
                raise InvalidInputError(f"{len(self.columns)} values are needed, not {len(r)}")
        self._live = SeriesRunner(self.dag)
        data = np.array([[np.nan if v is None else float(v) for v in r] for r in rows]).reshape(len(rows), len(self.columns))
        out = self._live.step({n: data[:, k] for k, n in enumerate(self.columns)})
        return np.stack([out[n] for n in self.output_names()], 1).tolist() if len(rows) else []

    # -- batch ------------------------------------------------------------------------------------

    def transform(self, df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], keep_input: bool = True) -> DataFrame:
        """df with the outputs as columns (with keep_input=False: key, order and outputs only).

        One shuffle on the key. Features that built-in aggregates express become window expressions, all of a
        level in one window operator; the others run, with what depends on them, in one Arrow pass over the
        sorted partitions, which holds a batch of rows and the runner's state, however long a series is.
        An output that has an input's name replaces it.
        """
        key, order = _named(key), _named(order)
        if df.isStreaming:
            raise InvalidConfigError("use transform_stream on a stream")
        _present(df, [*self.columns, *key, *order])
        rest = [c for c in df.columns if c in {*key, *order} or keep_input]
        hidden = {n: f"__in_{k}" for k, n in enumerate(self.columns)}
        work = df.select(*rest, *[clean(F.col(f"`{n}`")).alias(h) for n, h in hidden.items()])
        if self._slow and key:
            work = work.repartition(*key)  # the windows and the Arrow pass share this shuffle
        w = window_order(key, order)
        for depth in sorted(set(self.dag.depth)):
            nodes = [i for i, d in enumerate(self.dag.depth) if d == depth and i not in set(self._slow)]
            if nodes:
                work = _level(work, [self.dag.features[i] for i in nodes], hidden, w)
                hidden = hidden | {n: f"__out_{n}" for i in nodes for n in self.dag.features[i].output_names()}
        if self._slow:
            work = self._arrow_pass(work, rest, hidden, key, order)
        outputs = self.output_names()
        return work.select(*[f"`{c}`" for c in rest if c not in outputs], *[F.col(f"`__out_{n}`").alias(n) for n in outputs])

    def transform_spread(self, df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], partitions: int | None = None, keep_input: bool = True) -> DataFrame:
        """The same, with rows dealt by range: for a hot series, or a long one without a key. No Ema or Kama."""
        from .spread import transform_spread

        return transform_spread(self, df, _named(key), _named(order), partitions, keep_input)

    def _arrow_pass(self, work: DataFrame, rest: list[str], hidden: dict[str, str], key: list[str], order: list[str]) -> DataFrame:
        dag, nodes = self.dag, self._slow
        made_before = [n for i, f in enumerate(dag.features) if i not in set(nodes) for n in f.output_names()]
        sources = {n: hidden[n] for n in hidden if any(n in dag.features[i].input_names() for i in nodes)}
        made = [n for i in nodes for n in dag.features[i].output_names()]
        carried = [*rest, *[f"__out_{n}" for n in made_before], *[h for h in dict.fromkeys(sources.values()) if not h.startswith("__out_")]]
        work = work.select(*[f"`{c}`" for c in carried])
        schema = T.StructType([*work.schema.fields, *[T.StructField(f"__out_{n}", T.DoubleType()) for n in made]])
        arrow = to_arrow_schema(schema)
        at = {c: k for k, c in enumerate(carried)}

        def run(batches):
            runner, series = SeriesRunner(dag, nodes), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = [batch.column(at[k]) for k in key]
                edges = [0, *(np.flatnonzero(np.logical_or.reduce([changes(c) for c in ids])) + 1).tolist(), batch.num_rows] if key else [0, batch.num_rows]
                values = {n: batch.column(at[h]).to_numpy(zero_copy_only=False) for n, h in sources.items()}
                parts = {n: [] for n in made}
                for a, b in zip(edges, edges[1:]):
                    own = tuple(c[a] for c in ids)
                    if series is None or any(not same(x, y) for x, y in zip(own, series)):
                        runner.reset()
                        series = own
                    got = runner.step({n: v[a:b] for n, v in values.items()})
                    for n in made:
                        parts[n].append(got[n])
                out = [pa.array(x, from_pandas=True) for x in (np.concatenate(parts[n]) for n in made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *out], arrow)], schema=arrow)

        if key:
            ready = work.sortWithinPartitions(*key, *order)
        else:
            ready = work.repartition(1).sortWithinPartitions(*order)
        return ready.mapInArrow(run, schema)

    # -- streams ------------------------------------------------------------------------------------

    def transform_stream(self, df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], initial: DataFrame | None = None) -> DataFrame:
        from ..streaming.processor import transform_stream

        return transform_stream(self, df, _named(key), _named(order), initial)


def changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before, for all but the first; nulls and NaNs are equal to their like."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def same(a: pa.Scalar, b: pa.Scalar) -> bool:
    x, y = a.as_py(), b.as_py()
    return x == y or (x != x and y != y)


def _present(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in dict.fromkeys(needed) if c not in df.columns]
    if missing:
        raise MissingInputColumnError(f"the table has no column {missing!r}")


class TargetPipeline:
    """Independent targets over `input_columns`."""

    def __init__(self, targets: Sequence[Target], input_columns: Sequence[str]):
        targets, columns = list(targets), list(input_columns)
        for t in targets:
            if not isinstance(t, Target):
                raise InvalidConfigError(f"{t!r} is no target")
        if not targets:
            raise InvalidConfigError("a pipeline needs a target")
        _unique_inputs(columns)
        names = [n for t in targets for n in t.output_names()]
        for n in names:
            if names.count(n) > 1:
                raise DuplicateOutputKeyError(f"{n!r} is written twice")
        missing = [n for t in targets for n in t.input_names() if n not in columns]
        if missing:
            raise MissingInputColumnError(f"not among the inputs: {missing!r}")
        self.targets, self.columns = targets, columns

    def __len__(self) -> int:
        return len(self.targets)

    def __repr__(self) -> str:
        return f"TargetPipeline({self.targets!r}, input_columns={self.columns!r})"

    def input_names(self) -> list[str]:
        return list(self.columns)

    def output_names(self) -> list[str]:
        return [n for t in self.targets for n in t.output_names()]

    def warm_up_period(self) -> int:
        return max(t.warm_up_period() for t in self.targets)

    def forward_period(self) -> int:
        return max(t.forward_period() for t in self.targets)

    def run_research(self, columns: Sequence[Sequence[float | None]]) -> list[list[float]]:
        """The targets, as columns, of one local series given as columns in the order of the inputs; NaN for no value."""
        x = dict(zip(self.columns, local(columns, len(self.columns))))
        return [o.tolist() for t in self.targets for o in t.kernel([x[n] for n in t.input_names()])]

    def transform(self, df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], keep_input: bool = True) -> DataFrame:
        """df with the targets as columns: one shuffle on the key, all targets in one pass of window operators."""
        key, order = _named(key), _named(order)
        if df.isStreaming:
            raise InvalidConfigError("targets look ahead; they can't run on a stream")
        _present(df, [*self.columns, *key, *order])
        rest = [c for c in df.columns if c in {*key, *order} or keep_input]
        hidden = {n: f"__in_{k}" for k, n in enumerate(self.columns)}
        work = df.select(*rest, *[clean(F.col(f"`{n}`")).alias(h) for n, h in hidden.items()])
        work = _level(work, self.targets, hidden, window_order(key, order))
        outputs = self.output_names()
        return work.select(*[f"`{c}`" for c in rest if c not in outputs], *[F.col(f"`__out_{n}`").alias(n) for n in outputs])
