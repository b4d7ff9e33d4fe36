"""Spark-first quality control and preparation of labelled sequence and text collections."""

__version__ = "0.1.0"
