import random

import pytest
from pyspark.sql import functions as F

from verbarium.operators.running import running_rank, running_total


def rows(seed, n, groups, values):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.randrange(values), i) for i in range(n)]


@pytest.mark.parametrize(("groups", "values", "parts"), [([1], 2, 7), ([None, 1, 1, 1, 2], 5, 9), (list(range(40)), 3, 4), ([1, 2], 10**6, 5)])
def test_places(spark, groups, values, parts):
    data = rows(len(groups), 300, groups, values)
    df = spark.createDataFrame(data, "g int, v int, i int")
    got = {r.i: r.place for r in running_rank(df, ["g"], [("v", False)], "i", "place", parts).collect()}
    assert got == {i: 1 + sum(h == g and w > v for h, w, _ in data) for g, v, i in data}


def test_totals(spark):
    data = rows(8, 200, [None, 1, 1, 2], 50)
    df = spark.createDataFrame(data, "g int, v int, i int")
    got = {r.i: r.t for r in running_total(df, ["g"], [F.col("v").asc(), F.col("i").asc()], F.col("v"), "t", 6).collect()}
    assert got == {i: sum(w for h, w, k in data if h == g and (w, k) < (v, i)) for g, v, i in data}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g int, v int, i int")
    assert running_rank(df, ["g"], [("v", True)], "i", "place").count() == running_total(df, ["g"], [F.col("v").asc()], F.col("v"), "t").count() == 0
