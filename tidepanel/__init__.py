"""Spark-native operators for (instrument x session) time-series panels."""

__version__ = "0.1.0"
