"""Per-key results where a few keys hold most rows (problem 7).

Value-frequency compression: rows are first counted by key *and* value, so a hot key is
spread over as many tasks as it has values, and equal rows shrink before the shuffle. All
per-key results then come from these weighted values: row counts, sums, distinct counts,
modes and percentiles are exact.

Defined cases: a null key is a key of its own; null values count as rows but not as values;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.operators.running import running_total
from verbarium.session import materialize


def value_frequencies(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``key, value, n``: how often each value stands with each key."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def per_key(freqs: DataFrame) -> DataFrame:
    """``key, rows, total, n_distinct``; ``total`` is the sum of numeric values, null for others."""
    numeric = freqs.schema["value"].dataType.typeName() in {"byte", "short", "integer", "long", "double", "float", "decimal"}
    total = F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0)) if numeric else F.lit(None).cast("long")
    return freqs.groupBy("key").agg(F.sum("n").alias("rows"), total.alias("total"), F.count("value").alias("n_distinct"))


def per_key_mode(freqs: DataFrame) -> DataFrame:
    """``key, mode, mode_rows``: the most frequent value of each key; of several the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("value")))
    return freqs.filter("value is not null").groupBy("key").agg(best.alias("b")).select("key", F.col("b.value").alias("mode"), (-F.col("b.n")).alias("mode_rows"))


def per_key_percentiles(freqs: DataFrame, shares: list[float]) -> DataFrame:
    """``key, share, value``: the smallest value with at least ``share`` of the key's values at or below it."""
    values = materialize(freqs.filter("value is not null"), "values")
    totals = values.groupBy("key").agg(F.sum("n").alias("t"))
    below = running_total(values, ["key"], [F.col("value").asc()], F.col("n"), "before")
    # One row per key on this side; adaptive execution splits a hot key's values on the other.
    joined = below.alias("b").join(totals.alias("t"), F.col("b.key").eqNullSafe(F.col("t.key"))).select("b.*", "t.t")
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    place = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("t") - 1e-9))
    return joined.select("*", share).filter((F.col("before") < place) & (place <= F.col("before") + F.col("n"))).select("key", "share", "value")


def heavy_keys(summary: DataFrame, share: float) -> DataFrame:
    """``key, rows`` of the keys with at least ``share`` of all rows; the null key is none."""
    summary = materialize(summary.select("key", "rows"), "keys")
    total = summary.agg(F.sum("rows").alias("t"))  # one row
    return summary.crossJoin(F.broadcast(total)).filter(F.col("key").isNotNull() & (F.col("rows") >= share * F.col("t") - 1e-9)).select("key", "rows")
