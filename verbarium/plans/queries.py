"""The queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbarium.plans import reference, skew
from verbarium.plans.reference import tfidf_top10  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**reference.QUERIES, **skew.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reference.ORACLE, **skew.ORACLE}
