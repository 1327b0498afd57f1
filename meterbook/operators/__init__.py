"""Responses, pricing, ledger and reconciliation as DataFrame transforms."""
