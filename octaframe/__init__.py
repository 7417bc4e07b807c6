"""Spark-first lossless compression and byte analytics."""

__version__ = "0.1.0"
VERSION = (0, 1, 0)
