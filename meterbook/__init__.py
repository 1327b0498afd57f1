"""Priced usage ledgers and usage marts for coding-agent transcripts, on Spark."""
