"""Whole jobs out of the operators."""
