"""Structured Streaming over event logs."""
