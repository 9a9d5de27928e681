"""A Spark-native semantic analytics engine."""

__version__ = "0.1.0"
