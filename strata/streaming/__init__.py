"""Structured Streaming: triggered append-only ingest."""

from strata.streaming.ingest import await_all, ingest, start_ingest

__all__ = ["await_all", "ingest", "start_ingest"]
