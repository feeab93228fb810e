"""Structured Streaming operators over append-only logs."""
