"""Runs a feature DAG over one series in pieces: the kernel side of batch, streams and live use.

State is small and bounded: for each node the last `history()` rows of its inputs and a few numbers.
"""

from __future__ import annotations

import pickle

import numpy as np

from .dag import FeatureDag


class SeriesRunner:
    """Takes consecutive rows of one series; results do not depend on how they are cut into pieces."""

    def __init__(self, dag: FeatureDag, nodes: list[int] | None = None):
        self.dag = dag
        self.nodes = list(range(len(dag.features))) if nodes is None else nodes
        self.reset()

    def reset(self) -> None:
        self.held = {i: ([np.zeros(0)] * len(self.dag.features[i].inputs), [float("nan")] * self.dag.features[i].STATE) for i in self.nodes}

    def step(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The outputs for the next rows, by name. columns: inputs as doubles, NaN for null."""
        values = dict(columns)
        out = {}
        for i in self.nodes:
            f = self.dag.features[i]
            before, state = self.held[i]
            full = [np.concatenate([b, values[n]]) for b, n in zip(before, f.input_names())]
            skip = len(before[0])
            if len(full[0]) == skip:
                result = [np.zeros(0)] * len(f.outputs)
            else:
                result, state = f.kernel(full, skip, state)
            keep = f.history()
            self.held[i] = ([x[len(x) - min(keep, len(x)) :].copy() for x in full], state)
            for name, r in zip(f.output_names(), result):
                out[name] = values[name] = r[skip:]
        return out

    def dump(self) -> bytes:
        return pickle.dumps(self.held)

    def load(self, data: bytes) -> None:
        self.held = pickle.loads(data)  # written by `dump` into the engine's own state store
