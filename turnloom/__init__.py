"""Turnloom: Spark-native analytics over time-stamped conversation data."""

__version__ = "0.1.0"
