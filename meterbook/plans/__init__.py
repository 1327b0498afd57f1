"""Marts: dashboard answers over the sessions table."""
