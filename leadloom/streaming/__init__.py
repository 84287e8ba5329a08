"""Structured Streaming versions of the time-driven rules."""
