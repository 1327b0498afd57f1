"""Structured Streaming: ingest, carry, ledger, health, traffic, settlement."""
