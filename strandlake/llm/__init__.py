"""Operators of large training-data pipelines; nothing outside this package imports it."""
