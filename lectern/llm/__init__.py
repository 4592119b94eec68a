"""Operators over a training corpus; nothing outside this package imports it."""
