"""Features on Structured Streaming."""

from .processor import drain, final_state, transform_stream

__all__ = ["drain", "final_state", "transform_stream"]
