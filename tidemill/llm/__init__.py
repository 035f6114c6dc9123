"""Operators for building training data: ten methods, each in a module of its own.

Nothing else in the library imports this subpackage.
"""
