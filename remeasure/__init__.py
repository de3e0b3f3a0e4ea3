"""Spark-native audit engine for repeated noisy measurements of the same entities."""

__version__ = "0.1.0"
