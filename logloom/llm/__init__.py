"""Operators for preparing training text, each in a module of its own.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only while the package is present.
"""
