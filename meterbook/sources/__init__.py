"""Readers and writers: transcripts, ledgers, price feeds, capture files."""
