"""Operators for large training-text collections; nothing outside this package imports it."""
