"""Errors of specifications and pipelines."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this package; no ValueError, so a handler of those does not catch it."""


class InvalidConfigError(EngineError):
    """A choice that does not exist, or objects that do not go together."""


class InvalidInputError(EngineError):
    """A parameter or an input of the wrong size."""


class MissingInputColumnError(EngineError):
    """A column that is neither an input nor an output of another node."""


class DuplicateOutputKeyError(EngineError):
    """Two nodes write one column."""


class CyclicDependencyError(EngineError):
    """Nodes that need each other's outputs."""
