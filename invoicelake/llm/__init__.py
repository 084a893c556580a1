"""Operators for large training-data corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only where it is installed.
"""
