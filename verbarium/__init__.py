"""A Spark-native engine for text search, ranking and corpus statistics."""

__version__ = "0.1.0"
