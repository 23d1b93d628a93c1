"""Structured Streaming jobs for live upkeep."""
