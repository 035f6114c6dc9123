"""Readers of half-structured inputs, and keyed writes."""
