"""Levels of features: each reads only inputs and the outputs of levels before."""

from __future__ import annotations

from ..errors import CyclicDependencyError, DuplicateOutputKeyError
from ..operators.base import Transform


class FeatureDag:
    """Orders features by the names that they read and write.

    Inside a level a feature comes where the last of those that it reads from comes in the level before;
    declaration order holds among features that wait for the same one.
    """

    def __init__(self, features: list[Transform]):
        writer: dict[str, int] = {}
        for i, f in enumerate(features):
            for name in f.output_names():
                if name in writer:
                    raise DuplicateOutputKeyError(f"{name!r} is written by {features[writer[name]]!r} and {f!r}")
                writer[name] = i
        # a feature that reads its own output overwrites an input of that name: no dependency
        self.parents = [sorted({writer[n] for n in f.input_names() if writer.get(n, i) != i}) for i, f in enumerate(features)]
        depth: dict[int, int] = {}
        while len(depth) < len(features):
            ready = [i for i in range(len(features)) if i not in depth and all(p in depth for p in self.parents[i])]
            if not ready:
                stuck = [features[i] for i in range(len(features)) if i not in depth]
                raise CyclicDependencyError(f"these need each other: {stuck!r}")
            for i in ready:
                depth[i] = 1 + max((depth[p] for p in self.parents[i]), default=-1)
        place: dict[int, int] = {}
        for d in sorted(set(depth.values())):
            level = [i for i in range(len(features)) if depth[i] == d]
            for i in sorted(level, key=lambda i: (max((place[p] for p in self.parents[i]), default=0), i)):
                place[i] = len(place)
        self.order = list(place)
        self.features = [features[i] for i in self.order]
        self.depth = [depth[i] for i in self.order]
        self.parents = [[place[p] for p in self.parents[i]] for i in self.order]
        self.writer = {n: place[i] for n, i in writer.items()}

    def levels(self) -> list[list[Transform]]:
        out: list[list[Transform]] = []
        for f, d in zip(self.features, self.depth):
            out += [[]] * (d + 1 - len(out))
            out[d] = [*out[d], f]
        return out

    def output_names(self) -> list[str]:
        return [n for f in self.features for n in f.output_names()]

    def required(self) -> list[str]:
        """Names that no other feature writes, in the order first seen."""
        found = [n for i, f in enumerate(self.features) for n in f.input_names() if self.writer.get(n, i) == i]
        return list(dict.fromkeys(found))

    def effective_warm_up(self) -> int:
        """Rows until every output can have a value: the longest sum along a chain."""
        own: list[int] = []
        for f, parents in zip(self.features, self.parents):
            own.append(f.warm_up_period() + max((own[p] for p in parents), default=0))
        return max(own, default=0)
