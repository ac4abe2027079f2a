"""Operators for text and sequence training data; nothing outside this package imports it."""
