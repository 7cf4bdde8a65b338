"""Leafmill: document-intelligence transforms for Spark DataFrames."""

__version__ = "0.1.0"
