"""PageRank over a table of links."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.session import drop_path, materialize, store


#: Links of one source that stay together; those of a source with more are spread over groups.
LINKS_PER_GROUP = 1_000_000
#: Steps in one job, where no step's change has to be known.
STEPS_PER_JOB = 5


def out_degrees(edges: DataFrame) -> DataFrame:
    """``src, out_degree``: links of each node, repeated ones counted."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links whose both ends are nodes."""
    ends = nodes.select("node").distinct()
    return edges.select("src", "dst").join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-5) -> DataFrame:
    """``node, score`` after ``iterations`` or once the scores change by less than ``tolerance`` in sum.

    All scores begin at 1; x' = (1 - d) + d A x, where a link's weight is one by its source's
    number of links, so repeated links weigh more and nodes without links pass nothing on.
    Links between other than ``nodes`` are left out.

    Repeated links are counted before the join. The links are partitioned by source once, those
    of a hot source by several groups to which its score is copied, and kept so for all
    steps; each step moves only the scores and the partial sums by target, so a hot target
    costs one row per task. The scores are written to the shared folder after every
    ``STEPS_PER_JOB`` steps, or each step if its change decides, which keeps plans short; older
    ones are removed. Kept links that are lost with an executor are read again from there.
    """
    spark = edges.sparkSession
    links = valid_edges(edges, nodes)
    groups = F.ceil(F.col("out_degree") / LINKS_PER_GROUP).cast("int")
    degree = out_degrees(links).withColumn("groups", groups)
    counted = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(degree, "src")
    weights = counted.select("src", F.pmod(F.xxhash64("dst"), F.col("groups")).alias("g"), "dst", (F.col("n") / F.col("out_degree")).alias("weight"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weights = materialize(weights, "weights").repartition(parts, "src", "g").persist(StorageLevel.MEMORY_AND_DISK)
    names = nodes.select("node").distinct().join(degree.select(F.col("src").alias("node"), "groups"), "node", "left")
    names = materialize(names.select("node", F.coalesce("groups", F.lit(1)).alias("groups")), "nodes")
    scores = names.withColumn("score", F.lit(1.0))
    stored = None
    try:
        for i in range(1, iterations + 1):
            copies = scores.select("node", "score", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups").cast("bigint") - 1)).alias("copy"))
            sums = weights.join(copies, (F.col("src") == F.col("node")) & (F.col("g") == F.col("copy"))).groupBy("dst").agg(F.sum(F.col("weight") * F.col("score")).alias("s"))
            step = names.join(sums, F.col("node") == F.col("dst"), "left").select("node", "groups", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
            done = i == iterations
            if tolerance is not None or done or i % STEPS_PER_JOB == 0:
                step, path = store(step, "scores")
                if tolerance is not None:
                    change = step.alias("a").join(scores.alias("b"), "node").agg(F.sum(F.abs(F.col("a.score") - F.col("b.score")))).first()[0]
                    done = done or change is None or change < tolerance
                if stored:
                    drop_path(spark, stored)
                stored = path
            scores = step
            if done:
                break
        return scores.select("node", "score")
    finally:
        weights.unpersist()


def ranked(scores: DataFrame) -> DataFrame:
    """Best first; of equal scores the smaller node."""
    return scores.orderBy(F.desc("score"), "node")


def best_node(scores: DataFrame) -> DataFrame:
    """``node, score`` of the best node, of equal ones the smallest; one partial maximum per task."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("node").alias("node")))
    return scores.agg(best.alias("b")).select(F.col("b.node").alias("node"), (-F.col("b.s")).alias("score"))
