"""Structured Streaming jobs over incoming reports and responses."""
