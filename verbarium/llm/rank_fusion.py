"""One ranking from scores of different scales (problem 6).

Median rank aggregation: an item's place in each score counts, not the score. Items are
ordered by the weighted median of their places, then by the mean, then by identifier.

Places are found without putting a group, or the items of one value, into one task: the scores
are range-partitioned by group, metric, value and item, and places are counted within slices
and corrected by a small table of slices.

Defined cases: null, NaN and absent scores share the last place; equal scores share the best
place of theirs; repeated rows of an item are one item with the best of each score; rows
with a null group or item are no candidates; an empty table gives an empty ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbarium.operators.running import running_rank, running_total
from verbarium.session import materialize


def clean_score(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))


def latest_scores(store: DataFrame, node: str = "node", score: str = "score", run_at: str = "run_at") -> DataFrame:
    """``node, score`` of the latest run of each node, whatever the score; of equal times the higher score."""
    last = F.max(F.struct(F.col(run_at).alias("t"), clean_score(F.col(score)).alias("s")))
    return store.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(last.alias("m")).select("node", F.col("m.s").alias("score"))


def places(items: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """``group, item, metric, place`` of each item in each score."""
    stacked = items.select(
        group,
        item,
        F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.col(s).isNull().alias("absent"), F.coalesce(s, F.lit(0.0)).alias("value")) for i, s in enumerate(scores)])).alias("x"),
    ).select(group, item, "x.*")
    order = [("absent", True), ("value", False)]
    return running_rank(stacked, [group, "metric"], order, item, "place").select(group, item, "metric", "place")


def weighted_median(pairs: Column, total: float) -> Column:
    """Of sorted ``(place, weight)`` structs; between two middle places it is their mean."""

    def first(reached) -> Column:
        start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("m"))
        return F.aggregate(
            pairs,
            start,
            lambda a, x: F.struct(
                (a["w"] + x["weight"]).alias("w"),
                F.when(a["m"].isNull() & reached(a["w"] + x["weight"]), x["place"].cast("double")).otherwise(a["m"]).alias("m"),
            ),
            lambda a: a["m"],
        )

    half = total / 2
    return (first(lambda w: w >= half - 1e-9) + F.coalesce(first(lambda w: w > half + 1e-9), first(lambda w: w >= half - 1e-9))) / 2


def fused(items: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """``group, item, median_place, mean_place`` of each distinct item."""
    weights = weights or [1.0] * len(scores)
    once = (
        items.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(group, item)
        .agg(*[F.max(clean_score(F.col(s))).alias(s) for s in scores])
    )
    once = materialize(once, "items")
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("metric") + 1)
    pairs = F.array_sort(F.collect_list(F.struct("place", of.alias("weight"))))
    total = float(sum(weights))
    mean = F.aggregate("pairs", F.lit(0.0), lambda a, x: a + x["place"] * x["weight"]) / total
    return (
        places(once, group, item, scores)
        .groupBy(group, item)
        .agg(pairs.alias("pairs"))
        .select(group, item, weighted_median(F.col("pairs"), total).alias("median_place"), mean.alias("mean_place"))
    )


def best_items(items: DataFrame, group: str, item: str, scores: list[str], k: int, weights: list[float] | None = None) -> DataFrame:
    """The ``k`` best items of each group; every task keeps only its own best before the shuffle."""
    order = W.partitionBy(group).orderBy("median_place", "mean_place", item)
    return fused(items, group, item, scores, weights).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def full_ranking(items: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """Every item with its ``place`` in its group."""
    order = [F.col("median_place").asc(), F.col("mean_place").asc(), F.col(item).asc()]
    ranked = running_total(fused(items, group, item, scores, weights), [group], order, F.lit(1), "before")
    return ranked.withColumn("place", F.col("before") + 1).drop("before")
