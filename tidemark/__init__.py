"""Tidemark: regime analysis of ordered series, and corpus preparation, on Spark."""

__version__ = "0.1.0"
