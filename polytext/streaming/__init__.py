"""Structured Streaming jobs: incremental scoring of newly arrived shards (K1)
and a live progress aggregate over a step log (K2)."""
