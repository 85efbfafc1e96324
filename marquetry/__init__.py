"""Marquetry: a PySpark-native engine for code-structure and text-quality analytics."""

__version__ = "0.1.0"
