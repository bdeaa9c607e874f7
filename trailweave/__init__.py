"""Associative-memory analytics on Spark."""
