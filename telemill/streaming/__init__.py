"""Structured Streaming forms of the operators."""

from telemill.streaming.failure_windows import stream_failure_windows, start_failure_window_stream  # noqa: F401
