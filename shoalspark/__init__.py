"""Spark-first analytics for hyperspectral aquatic remote sensing."""

__version__ = "0.1.0"
