"""Composite analyses chained from operators."""
