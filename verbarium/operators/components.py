"""Connected components of a graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` of every node of ``edges(src, dst)``; a component is named by its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    node that it knows; the number of rounds grows with the logarithm of the diameter. Each
    round's edges are written to the shared folder. Null ends are no edges; a self-loop makes
    its node a component.
    """
    ends = edges.filter("src is not null and dst is not null")
    nodes = materialize(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    links = materialize(ends.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    last = None
    for _ in range(max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        links = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small"
        )
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components need more rounds")
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
