"""One stateful processor per key runs a whole feature DAG on a stream.

Rows of a key are sorted by the order columns inside each micro-batch; a row that does not come after the
last one already taken is late and dropped, since features can't be revised. The state of a key is one binary
value: the runner's bounded history and the last order values.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import InvalidConfigError, MissingInputColumnError
from ..plans.runner import SeriesRunner

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = T.StructType([T.StructField("state", T.BinaryType())])


class FeatureProcessor(StatefulProcessor):
    """Runs a pipeline's DAG for each key."""

    def __init__(self, dag, columns: list[str], order: list[str], names: list[str], picked: list[str]):
        self.dag, self.columns, self.order, self.names, self.picked = dag, columns, order, names, picked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values(self.order, kind="stable", ignore_index=True)
        runner, last = SeriesRunner(self.dag), None
        if self.state.exists():
            held, last = pickle.loads(bytes(self.state.get()[0]))
            runner.load(held)
        places = list(pdf[self.order].itertuples(index=False, name=None))
        taken = []
        for p in places:
            taken.append(last is None or p > last)
            last = p if taken[-1] else last
        pdf = pdf[np.array(taken, bool)].reset_index(drop=True)
        out = runner.step({c: pd.to_numeric(pdf[c]).to_numpy(float, na_value=np.nan) for c in self.columns})
        self.state.update((pickle.dumps((runner.dump(), last)),))
        if len(pdf):
            for n in self.names:
                pdf[n] = pd.array(np.where(np.isnan(out[n]), np.nan, out[n]), "Float64")
            yield pdf[self.picked]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((bytes(initialState["state"].iloc[0]),))

    def close(self) -> None:
        pass


def transform_stream(pipeline, df: DataFrame, key: list[str], order: list[str], initial: DataFrame | None = None) -> DataFrame:
    """The stream with the outputs as columns (append mode). initial: `final_state` of a batch, to go on from.

    A series without a key is no stream of its own: give a constant column. Needs the RocksDB state store, which is set
    for the session if none was chosen.
    """
    if not key:
        raise InvalidConfigError("a stream needs a key")
    missing = [c for c in [*pipeline.input_names(), *key, *order] if c not in df.columns]
    if missing:
        raise MissingInputColumnError(f"the stream has no column {missing!r}")
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = pipeline.output_names()
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in names], *[T.StructField(n, T.DoubleType()) for n in names]])
    picked = [f.name for f in schema.fields]
    processor = FeatureProcessor(pipeline.dag, pipeline.input_names(), order, names, picked)
    start = None if initial is None else initial.groupBy(*key)
    return df.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "None", start)


def final_state(pipeline, df: DataFrame, key: list[str] | str, order: list[str] | str) -> DataFrame:
    """(key, state): each series' state after all rows of a batch, to start a stream from."""
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    columns, dag = pipeline.input_names(), pipeline.dag
    work = df.select(*dict.fromkeys([*key, *order, *columns])).repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*[df.schema[k] for k in key], *STATE_SCHEMA.fields])

    def run(frames):
        runner, series, last = SeriesRunner(dag), None, None

        def done():
            row = dict(zip(key, series)) | {"state": pickle.dumps((runner.dump(), last))}
            return pd.DataFrame([row], columns=[*key, "state"])

        for pdf in frames:
            for own, part in pdf.groupby(key, sort=False, dropna=False):
                if series is not None and own != series:
                    yield done()
                    runner.reset()
                series = own
                runner.step({c: pd.to_numeric(part[c]).to_numpy(float, na_value=np.nan) for c in columns})
                last = tuple(part[order].iloc[-1])
        if series is not None:
            yield done()

    return work.mapInPandas(run, schema)


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is available now into Parquet files under `folder`, and read them.

    The folder also takes the checkpoint; a run that broke off goes on from there.
    """
    query = df.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")
