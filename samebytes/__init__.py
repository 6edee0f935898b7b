"""Exact-duplicate file catalog on Spark: plain DataFrame functions plus one data source."""

__version__ = "0.1.0"
