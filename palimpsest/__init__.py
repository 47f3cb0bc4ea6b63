"""Palimpsest: retrieval, temporal, lifecycle and coordination queries over memory logs, as Spark plans."""
