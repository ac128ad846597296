"""Items of different sizes in containers of one capacity (problem 9).

Exact-complement hashing: what matters of the items is how often each size occurs, a table
of at most ``capacity`` rows. On it the plan is made: pairs and triples of sizes that fill
a container exactly, found by the hash of the missing sum and taken as often as all of
them are available; then the rest by best fit, largest first, whole counts at a time. The
plan names patterns of sizes and how often each is used; its length depends on the
capacity only. The items then find their containers in parallel, by their running number
within their size.

Items above the capacity are split into full containers and a rest, which is packed like
any other item. Items without size are left out. Defined cases: null and empty texts have no
tokens; repeated rows are items of their own; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.operators.running import running_total
from verbarium.session import materialize

Pattern = tuple[int, ...]


def _exact(counts: Counter, capacity: int) -> Iterator[tuple[Pattern, int]]:
    """Patterns of one, two and three sizes that fill a container, largest size first."""
    if counts[capacity]:
        yield (capacity,), counts.pop(capacity)
    for big in sorted(counts, reverse=True):
        gap = capacity - big
        if gap <= big:
            uses = counts[big] // 2 if gap == big else min(counts[big], counts[gap])
            if uses and gap:
                counts[big] -= uses
                counts[gap] -= uses
                yield (big, gap), uses
    for big in sorted(counts, reverse=True):
        gap = capacity - big
        # Pair sums are indexed by their larger half: the other one is the hash of what is missing.
        for middle in range(min(big, gap - 1), (gap - 1) // 2, -1):
            if not counts[big]:
                break
            small = gap - middle
            if not counts[middle] or not counts[small]:
                continue
            pattern = (big, middle, small)
            uses = min(counts[s] // pattern.count(s) for s in pattern)
            if uses:
                for s in pattern:
                    counts[s] -= uses
                yield pattern, uses


def _best_fit(counts: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """The rest, largest first, each into the fullest container that has room; equal containers move together."""
    by_gap: dict[int, Counter] = defaultdict(Counter)
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern, n: int) -> None:
        if not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap][pattern] += n

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                # New containers, each with as many of this size as fit.
                each = min(left, capacity // size)
                n = left // each
                put(capacity - each * size, (size,) * each, n)
                left -= n * each
                continue
            gap = gaps[at]
            pattern, there = next(iter(by_gap[gap].items()))
            # Into as many equal containers as there are, in each as often as it fits.
            each = min(left, gap // size)
            n = min(there, left // each)
            by_gap[gap][pattern] -= n
            if not by_gap[gap][pattern]:
                del by_gap[gap][pattern]
            if not by_gap[gap]:
                gaps.pop(at)
            put(gap - each * size, pattern + (size,) * each, n)
            left -= n * each
    return [(p, n) for c in by_gap.values() for p, n in c.items()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of sizes and how many containers each fills."""
    left = Counter({s: n for s, n in counts.items() if 0 < s <= capacity and n > 0})
    return [*_exact(left, capacity), *_best_fit(left, capacity)]


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``container_id, key, part_no, first, size``: where each part of each item lies.

    ``part_no`` counts an item's parts from 0 and ``first`` is the part's first unit. All
    parts but the last of a split item are full containers.
    """
    spark = items.sparkSession
    base = materialize(items.filter(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")), "items")
    rest = base.select("key", (F.col("size") % capacity).alias("part"), F.floor(F.col("size") / capacity).cast("int").alias("part_no")).filter("part > 0")
    counts = {r.part: r.n for r in rest.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows, container, used = [], 0, Counter()
    for pattern, n in plan(counts, capacity):
        for s, each in Counter(pattern).items():
            rows.append((s, used[s], used[s] + n * each, each, container))
            used[s] += n * each
        container += n
    slots = spark.createDataFrame(rows, "s long, start long, stop long, each int, base long")
    numbered = running_total(rest, ["part"], [F.col("key").asc(), F.col("part_no").asc()], F.lit(1), "no")
    placed = numbered.join(F.broadcast(slots), (F.col("part") == F.col("s")) & (F.col("no") >= F.col("start")) & (F.col("no") < F.col("stop"))).select(
        (F.col("base") + F.floor((F.col("no") - F.col("start")) / F.col("each"))).alias("container_id"), "key", "part_no", (F.col("part_no").cast("long") * capacity).alias("first"), F.col("part").alias("size")
    )
    long = base.filter(F.col("size") >= capacity).withColumn("full", F.floor(F.col("size") / capacity).cast("int")).withColumn("all", F.lit(0))
    whole = running_total(long, ["all"], [F.col("key").asc()], F.col("full"), "before").select(
        "key", "before", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no")
    )
    full = whole.select(
        (F.col("before") + F.col("part_no") + container).alias("container_id"), "key", "part_no", (F.col("part_no").cast("long") * capacity).alias("first"), F.lit(capacity).cast("long").alias("size")
    )
    return placed.unionByName(full).select("container_id", F.col("key").alias(key), "part_no", "first", F.col("size").alias(size))
