"""Operators for text pipelines; nothing else in the library imports this package."""
