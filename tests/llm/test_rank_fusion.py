import math
import random
from statistics import median

from verbarium.llm.rank_fusion import best_items, full_ranking, latest_scores

SCORES = ["x", "y", "z"]
SCHEMA = "q int, item bigint, x double, y double, z bigint, place int, metric int, before int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def clean(v):
    return None if v is None or math.isnan(v) else v


def brute(rows, weights=None):
    groups = {}
    for q, i, *s in rows:
        if q is None or i is None:
            continue
        old = groups.setdefault(q, {}).get(i, [None] * 3)
        groups[q][i] = [max([v for v in (a, clean(b)) if v is not None], default=None) for a, b in zip(old, s)]
    out = {}
    for q, items in groups.items():
        places = {i: [] for i in items}
        for k in range(3):
            for i, s in items.items():
                better = sum(1 for o in items.values() if (o[k] is not None) and (s[k] is None or o[k] > s[k]))
                places[i].append(better + 1)
        order = sorted(items, key=lambda i: (median(places[i]), sum(places[i]) / 3, i))
        for p, i in enumerate(order, 1):
            out[q, i] = p
    return out


def sample():
    rng = random.Random(3)
    pick = lambda v: rng.choice([None, math.nan, v, v, v, 0.0, -0.0])
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 6), rng.randrange(120), pick(rng.random()), pick(rng.gauss(0, 1e6)), rng.choice([None, 0, 1, 2, 10**9])) for _ in range(600)]
    return rows + rows[:50] + [(None, 1, 1.0, 1.0, 1), (9, None, 1.0, 1.0, 1), (10, 5, None, None, None)]


def test_ranking_equals_brute_force(spark):
    rows = sample()
    got = {(r.q, r.item): r.place for r in full_ranking(table(spark, rows), "q", "item", SCORES).collect()}
    assert got == brute(rows)


def test_best_items(spark):
    rows = sample()
    got = {(r.q, r.item): r.place for r in best_items(table(spark, rows), "q", "item", SCORES, 5).collect()}
    assert got == {k: p for k, p in brute(rows).items() if p <= 5}


def test_weights(spark):
    rows = [(1, 1, 3.0, 1.0, 1), (1, 2, 2.0, 3.0, 2), (1, 3, 1.0, 2.0, 3)]
    got = [r.item for r in full_ranking(table(spark, rows), "q", "item", SCORES, [10.0, 1.0, 1.0]).orderBy("place").collect()]
    assert got == [1, 2, 3]


def test_empty_table(spark):
    assert full_ranking(table(spark, []), "q", "item", SCORES).count() == 0
    assert best_items(table(spark, []), "q", "item", SCORES, 5).count() == 0


def test_latest_scores(spark):
    rows = [(1, 5.0, 1), (1, None, 2), (2, math.nan, 3), (2, 9.0, 1), (3, 1.0, 1), (3, 1.0, 1), (4, 2.0, None), (4, 1.0, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "node int, score double, run_at int")
    assert {tuple(r) for r in latest_scores(df).collect()} == {(1, None), (2, None), (3, 1.0), (4, 1.0)}
