"""A pipeline over series too long for one task: rows are dealt by range, not by key.

Every transform but the recurrences depends on a bounded number of earlier rows, the pipeline's longest chain of
warm-ups. So the table is range-partitioned by key and order (a hot series, or a single one without a key, spreads
over many partitions), each partition is given that many rows from before its first one, and runs alone.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import InvalidConfigError
from ..functions.columns import clean
from .runner import SeriesRunner


def key_of(batch: pa.RecordBatch, key: Sequence[str], row: int) -> tuple:
    """A row's key; NaN is equal to itself here."""
    return tuple("NaN" if (v := batch.column(k)[row].as_py()) != v else v for k in key)


def transform_spread(pipeline, df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None = None, keep_input: bool = True) -> DataFrame:
    """What `transform` gives, for pipelines without recurrences (Ema, Kama).

    One range shuffle, written to the checkpoint folder so that both passes see the same partitions. The first
    pass brings each partition's last rows to the driver: as many as the longest chain needs, for each partition.
    """
    from .pipeline import _present, changes

    endless = [f for f in pipeline.dag.features if f.STATE]
    if endless:
        raise InvalidConfigError(f"these depend on all earlier rows; use transform: {endless!r}")
    key, order = list(key), list(order)
    _present(df, [*pipeline.columns, *key, *order])
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barweave-"))
    dag, names, need = pipeline.dag, pipeline.columns, pipeline.effective_warm_up()
    rest = [c for c in df.columns if c in {*key, *order} or keep_input]
    hidden = {n: f"__in_{k}" for k, n in enumerate(names)}
    work = df.select(*rest, *[clean(F.col(f"`{n}`")).alias(h) for n, h in hidden.items()])
    by = [*key, *order]
    dealt = work.repartitionByRange(partitions, *by) if partitions else work.repartitionByRange(*by)
    work = dealt.sortWithinPartitions(*by).checkpoint().withColumn("__part", F.spark_partition_id())

    tail_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("one", T.BooleanType()), *[work.schema[k] for k in key], *[T.StructField(h, T.DoubleType()) for h in hidden.values()]])
    tail_arrow = to_arrow_schema(tail_schema)

    def tails(batches):
        """The partition's last key, whether it had no other, and its last rows of it."""
        at, one, held, part = None, True, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = np.logical_or.reduce([changes(batch.column(k)) for k in key]) if key and batch.num_rows > 1 else np.zeros(0, bool)
            start = int(np.flatnonzero(edges)[-1]) + 1 if edges.any() else 0
            last = key_of(batch, key, batch.num_rows - 1)
            if start or (at is not None and last != at):
                one, held = one and at is None and not start, None
            at, part = last, batch.column("__part")[0].as_py()
            own = pa.table(batch.slice(start)).select([*key, *hidden.values()])
            held = own if held is None else pa.concat_tables([held, own])
            held = held.slice(max(0, held.num_rows - max(need, 1)))
        if held is not None:
            n = held.num_rows
            columns = [pa.array([part] * n), pa.array([one] * n), *held.columns]
            yield from pa.table(dict(zip(tail_arrow.names, columns))).cast(tail_arrow).combine_chunks().to_batches()

    found = work.mapInArrow(tails, tail_schema).toArrow()  # at most `need` rows a partition
    before, run_key, run = {}, None, np.zeros((0, len(names)))
    values = np.stack([found.column(h).to_numpy() for h in hidden.values()], 1).astype(float) if found.num_rows else run
    parts = found.column("part").to_numpy()
    for p in sorted(set(parts.tolist())):
        before[p] = (run_key, run)
        at = np.flatnonzero(parts == p)
        row = found.slice(int(at[0]), 1).combine_chunks().to_batches()[0]
        own = key_of(row, key, 0)
        joined = np.concatenate([run, values[at]]) if row.column("one")[0].as_py() and own == run_key else values[at]
        run_key, run = own, joined[len(joined) - min(len(joined), need) :]
    held = spark.sparkContext.broadcast(before)
    outputs = pipeline.output_names()
    kept = [c for c in rest if c not in outputs]
    schema = T.StructType([*[work.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in outputs]])
    arrow = to_arrow_schema(schema)

    def run_parts(batches):
        runner, series, fresh = SeriesRunner(dag), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if fresh:
                series, rows = held.value[batch.column("__part")[0].as_py()]
                if len(rows):
                    runner.step({n: rows[:, k] for k, n in enumerate(names)})
                fresh = False
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([changes(batch.column(k)) for k in key])) + 1).tolist(), batch.num_rows] if key else [0, batch.num_rows]
            x = {n: batch.column(h).to_numpy(zero_copy_only=False).astype(float) for n, h in hidden.items()}
            made = {n: [] for n in outputs}
            for a, b in zip(edges, edges[1:]):
                own = key_of(batch, key, a)
                if own != series:
                    runner.reset()
                    series = own
                for n, v in runner.step({n: v[a:b] for n, v in x.items()}).items():
                    made[n].append(v)
            columns = [*[batch.column(c) for c in kept], *[pa.array(np.concatenate(made[n]), from_pandas=True) for n in outputs]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return work.mapInArrow(run_parts, schema)
