"""Continuous variants of batch steps."""
