"""Structured Streaming forms of new-item detection and notification upkeep."""
