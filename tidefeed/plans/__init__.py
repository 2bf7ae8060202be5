"""Adapters from the given tables to feed records, and the registered query catalog."""
