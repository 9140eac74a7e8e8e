"""Structured Streaming ingest and rollup maintenance."""

from .jobs import (drain_and_stop, file_source, ingest_metrics, rollup_stream, start_ingest,
                   start_rollup)

__all__ = ["drain_and_stop", "file_source", "ingest_metrics", "rollup_stream", "start_ingest", "start_rollup"]
