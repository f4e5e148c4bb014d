"""What every transform and target is.

A specification is immutable. A transform says what it computes twice: as Spark columns over a window
order (`plan`, batch only), unless no built-in can express it, and as a vectorised kernel over one
series with a bounded history (`kernel`, batch and streams). Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql.window import WindowSpec

from ..errors import InvalidInputError


def whole(name: str, value: Any, least: int) -> int:
    """A parameter that must be an integer of at least `least`."""
    if isinstance(value, bool) or not isinstance(value, (int, np.integer)) or value < least:
        raise InvalidInputError(f"{name} must be an integer of at least {least}, not {value!r}")
    return int(value)


def names(what: str, value: Any, least: int, most: int | None) -> tuple[str, ...]:
    value = (value,) if isinstance(value, str) else tuple(value)
    if len(value) < least or (most is not None and len(value) > most) or not all(isinstance(v, str) and v for v in value):
        limit = f"{least}" if most == least else f"{least} or more" if most is None else f"{least} to {most}"
        raise InvalidInputError(f"{what}: {limit} column names are needed, not {list(value)!r}")
    return value


@dataclass(frozen=True)
class Transform:
    """Sees the present and the past of a series. Subclasses set how many inputs and outputs they take."""

    inputs: Sequence[str]
    N_IN: ClassVar[tuple[int, int | None]] = (1, None)
    N_OUT: ClassVar[int] = 1

    def __post_init__(self):
        object.__setattr__(self, "inputs", names("inputs", self.inputs, *self.N_IN))
        object.__setattr__(self, "outputs", names("outputs", self.outputs, self.N_OUT, self.N_OUT))
        if len(set(self.outputs)) < len(self.outputs):
            raise InvalidInputError(f"outputs repeat: {list(self.outputs)!r}")
        self.check()

    def check(self) -> None:
        """Validate parameters and settle defaults."""

    def settle(self, name: str, value: Any) -> None:
        object.__setattr__(self, name, value)

    def input_names(self) -> list[str]:
        return list(self.inputs)

    def output_names(self) -> list[str]:
        return list(self.outputs)

    def warm_up_period(self) -> int:
        """Rows at a series' start without a value."""
        return 0

    def history(self) -> int:
        """Earlier rows that a kernel needs to go on with a series (besides its `state`)."""
        return self.warm_up_period()

    @property
    def native(self) -> bool:
        """Whether `plan` exists."""
        return True

    def fresh(self) -> Transform:
        """A copy without live state."""
        return replace(self)

    def prepare(self, x: list[Column], order: WindowSpec) -> list[Column]:
        """Per-row terms that `plan` aggregates; they become columns of their own first."""
        return []

    def plan(self, x: list[Column], terms: list[Column], order: WindowSpec) -> list[Column]:
        """The outputs as columns. x: cleaned inputs (doubles, no NaN)."""
        raise NotImplementedError

    def kernel(self, x: list[np.ndarray], skip: int, state: list[float]) -> tuple[list[np.ndarray], list[float]]:
        """(outputs, state) for consecutive rows of one series; NaN stands for null.

        The first `skip` rows are history (`history()` of them at most): results for them are ignored, and `state`
        (`STATE` doubles, NaN at the start of a series) is that behind them.
        """
        raise NotImplementedError

    STATE: ClassVar[int] = 0

    # -- live use of one transform by itself; a missing value is NaN ------------------------------------

    def update(self, bar: Sequence[float | None]) -> list[float]:
        """The outputs for one more bar, its values in the order of `inputs`."""
        if len(bar) != len(self.inputs):
            raise InvalidInputError(f"{len(self.inputs)} values are needed, not {len(bar)}")
        history, state = self.__dict__.get("_live") or ([np.zeros(0)] * len(bar), [float("nan")] * self.STATE)
        x = [np.append(h, np.nan if v is None else float(v)) for h, v in zip(history, bar)]
        out, state = self.kernel(x, len(x[0]) - 1, state)
        keep = self.history()
        object.__setattr__(self, "_live", ([v[max(0, len(v) - keep) :] for v in x], state))
        return [float(o[-1]) for o in out]

    def reset(self) -> None:
        object.__setattr__(self, "_live", None)

    def parameters(self) -> dict[str, Any]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class Target:
    """Sees the future of a series; batch only."""

    inputs: Sequence[str]
    N_IN: ClassVar[tuple[int, int | None]] = (1, None)
    N_OUT: ClassVar[int] = 1
    LEAST: ClassVar[int] = 1
    horizon: int = field(default=1)

    def __post_init__(self):
        object.__setattr__(self, "inputs", names("inputs", self.inputs, *self.N_IN))
        object.__setattr__(self, "horizon", whole("horizon", self.horizon, self.LEAST))
        self.check()
        object.__setattr__(self, "outputs", names("outputs", self.outputs, self.N_OUT, self.N_OUT))
        if len(set(self.outputs)) < len(self.outputs):
            raise InvalidInputError(f"outputs repeat: {list(self.outputs)!r}")

    def check(self) -> None:
        pass

    def input_names(self) -> list[str]:
        return list(self.inputs)

    def output_names(self) -> list[str]:
        return list(self.outputs)

    def forward_period(self) -> int:
        return self.horizon

    def warm_up_period(self) -> int:
        return 0

    def prepare(self, x: list[Column], order: WindowSpec) -> list[Column]:
        return []

    def plan(self, x: list[Column], terms: list[Column], order: WindowSpec) -> list[Column]:
        raise NotImplementedError

    def kernel(self, x: list[np.ndarray]) -> list[np.ndarray]:
        """The outputs for one whole series; NaN stands for null."""
        raise NotImplementedError

    def run_research(self, columns: Sequence[Sequence[float | None]]) -> list[list[float]]:
        """The outputs, as columns, for one series given as columns in the order of `inputs`."""
        return [o.tolist() for o in self.kernel(local(columns, len(self.inputs)))]


def local(columns: Sequence[Sequence[float | None]], n: int) -> list[np.ndarray]:
    """Columns of one length as arrays with NaN for missing values."""
    if len(columns) != n or len({len(c) for c in columns}) > 1:
        raise InvalidInputError(f"{n} columns of one length are needed")
    return [np.array([np.nan if v is None else float(v) for v in c], float) for c in columns]
