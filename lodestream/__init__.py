"""Lodestream: a PySpark-native analytics engine for company-signal data."""

__version__ = "0.1.0"
