"""Structured Streaming entry points (incremental forms of batch operators)."""

from veracity.streaming.restatements import read_restatements, restatement_monitor  # noqa: F401
