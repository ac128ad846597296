"""The engine's Python functions for SQL; all others are built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verbarium.functions.porter import _stem_tokens, _stem_words


def register(spark: SparkSession) -> None:
    """``stem_word(string)`` and ``stem_tokens(array<string>)`` in SQL."""
    spark.udf.register("stem_word", _stem_words)
    spark.udf.register("stem_tokens", _stem_tokens)
