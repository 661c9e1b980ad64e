"""Structured Streaming forms of the operators."""

from .runs import analyse_stream, bar_states, closed_runs, stream_files

__all__ = ["analyse_stream", "bar_states", "closed_runs", "stream_files"]
