"""Spark-native structural analytics, with an optional sub-package of training-data operators."""

__version__ = "0.1.0"
