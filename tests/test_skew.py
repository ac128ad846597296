import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from verbarium.operators.components import connected_components
from verbarium.operators.running import running_total
from verbarium.operators.skew import heavy_keys, per_key, per_key_mode, per_key_percentiles, value_frequencies

SCHEMA = "key string, value int, n string, rows int, _w int"  # other columns have names used inside


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def sample():
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.choice([None, *range(40)])) for _ in range(4000)]
    return rows + [(None, 5), (None, None), ("lonely", None)]


def test_per_key_equals_plain_grouping(spark):
    rows = sample()
    freqs = value_frequencies(table(spark, rows), F.col("key"), F.col("value"))
    groups = defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    want = {k: (len(v), sum(x for x in v if x is not None), len({x for x in v if x is not None})) for k, v in groups.items()}
    assert {r.key: (r.rows, r.total, r.n_distinct) for r in per_key(freqs).collect()} == want
    modes = {}
    for k, v in groups.items():
        c = Counter(x for x in v if x is not None)
        if c:
            n = max(c.values())
            modes[k] = (min(x for x in c if c[x] == n), n)
    assert {r.key: (r["mode"], r.mode_rows) for r in per_key_mode(freqs).collect()} == modes
    shares = [0.01, 0.5, 1.0]
    quantiles = {}
    for k, v in groups.items():
        s = sorted(x for x in v if x is not None)
        for p in shares:
            if s:
                quantiles[k, p] = s[max(1, -int(-len(s) * p // 1)) - 1]
    assert {(r.key, r.share): r.value for r in per_key_percentiles(freqs, shares).collect()} == quantiles


def test_heavy_keys(spark):
    rows = [("a", 1)] * 50 + [("b", 2)] * 5 + [("c", i) for i in range(4)] + [(None, 1)] * 41
    summary = per_key(value_frequencies(table(spark, rows), F.col("key"), F.col("value")))
    assert {tuple(r) for r in heavy_keys(summary, 0.05).collect()} == {("a", 50), ("b", 5)}


def test_empty_table(spark):
    freqs = value_frequencies(table(spark, []), F.col("key"), F.col("value"))
    assert per_key(freqs).count() == per_key_mode(freqs).count() == per_key_percentiles(freqs, [0.5]).count() == heavy_keys(per_key(freqs), 0.1).count() == 0


def test_running_total_over_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {(r.g, r.o): r.t for r in running_total(df, ["g"], [F.col("o").desc()], F.col("w"), "t", partitions=7).collect()}
    want, sums = {}, Counter()
    for g, o, w in sorted(rows, key=lambda r: -r[1]):
        want[g, o] = sums[g]
        sums[g] += w
    assert got == want
    assert running_total(df.limit(0), ["g"], [F.col("o").asc()], F.col("w"), "t").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (5, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
