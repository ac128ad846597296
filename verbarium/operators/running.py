"""Running totals over groups of any size.

A plain window puts a whole group into one task. Here the rows are range-partitioned by
(group, order), so that a group that holds most of the table spans many tasks; each task
sums its own slice, and the slices' totals, one row per task and group, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbarium.session import materialize


def running_total(
    df: DataFrame, group: list[str], order: list[Column], weight: Column, out: str, partitions: int | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in its group.

    ``order`` must be a total order within a group for a defined result on equal rows;
    equal rows otherwise get their places in any order, with the same set of totals.
    Null groups are groups of their own. An empty table gives an empty table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = (
        df.withColumn("_w", weight.cast("long"))
        .repartitionByRange(n, *[F.col(c) for c in group], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    sliced = materialize(sliced, "running")
    totals = sliced.groupBy("_slice", *group).agg(F.sum("_w").alias("_t"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # Only a group that began in an earlier slice has an offset: at most one per slice.
    offsets = totals.withColumn("_o", F.sum("_t").over(before)).filter("_o is not null").drop("_t")
    inside = W.partitionBy("_slice", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = sliced.withColumn("_i", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["_slice", *group]]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    return (
        joined.alias("l")
        .join(F.broadcast(offsets).alias("r"), condition, "left")
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_i") + F.coalesce(F.col("_o"), F.lit(0))).alias(out))
    )


def running_rank(df: DataFrame, group: list[str], order: list[tuple[str, bool]], spread: str, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: one more than the rows of the group that stand strictly before this one; equal rows share it.

    ``order`` names the columns, without nulls, and whether they rise. Rows are range-partitioned
    by group, order and ``spread``, so that neither a large group nor many equal rows fill a
    task; where equal rows span slices, the place of their first slice counts. One row per
    slice and group is gathered to find that, and one per slice is broadcast.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc() if rises else F.col(c).desc() for c, rises in order]
    values = [c for c, _ in order]
    sliced = df.repartitionByRange(n, *[F.col(c) for c in group], *by, F.col(spread)).withColumn("_slice", F.spark_partition_id())
    ranked = materialize(sliced.withColumn("_r", F.rank().over(W.partitionBy("_slice", *group).orderBy(*by))), "ranks")
    last = F.max(F.struct(F.col("_r").alias("r"), *[F.col(c) for c in values])).alias("_last")
    every = ranked.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_n"), last)
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = every.withColumn("_o", F.sum("_n").over(before)).withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(*group)))
    # Only groups of several slices count here: about as many rows as there are slices.
    slices = materialize(slices.filter("_k > 1").select("_slice", *group, F.coalesce("_o", F.lit(0)).alias("_o"), "_last"), "slices")
    offsets = slices.select("_slice", *group, "_o")
    ties = slices.groupBy(*group, *[F.col(f"_last.{c}").alias(c) for c in values]).agg(F.min(F.col("_o") + F.col("_last.r")).alias("_start"))

    def on(columns: list[str], right: str):
        condition = F.lit(True)
        for c in columns:
            condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return condition

    joined = (
        ranked.alias("l").join(F.broadcast(offsets).alias("o"), on(["_slice", *group], "o"), "left").join(F.broadcast(ties).alias("t"), on([*group, *values], "t"), "left")
    )
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(F.col("_start"), F.col("_r") + F.coalesce("_o", F.lit(0))).alias(out))
