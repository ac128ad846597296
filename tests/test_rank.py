import math
from pathlib import Path
from random import Random

import pytest
from test_index import NAIVE, STEMMED, build

from verbarium.operators import graph, scoring, search
from verbarium.operators.index import TextIndex
from verbarium.session import scratch_root


def order(df):
    return [r.key for r in df.collect()]


def test_order_of_scores(spark):
    # Both words, then the one asked for twice, then the other; three segments.
    index = build(spark, ["moss grows on the wall", "lichens and moss share a stone", "some lichen"], 1, STEMMED)
    assert order(search.search_tfidf(index, ["moss", "lichens", "moss"])) == [1, 0, 2]


def test_formula(spark):
    texts = ["flute", "drum flute oboe", "oboe drum drum drum", "flute flute drum", "harp"]
    index = build(spark, texts, 2, NAIVE)
    query = ["drum", "flute", "drum"]
    idf = {t: math.log10(5 / sum(t in x.split() for x in texts) + 1) for t in ("drum", "flute")}
    want = {}
    for i, x in enumerate(texts[:4]):
        w = {t: x.split().count(t) * idf[t] for t in idf}
        want[i] = sum(w[t] * idf[t] * query.count(t) for t in idf) / math.sqrt(sum(v * v for v in w.values()))
    got = {r.key: r.score for r in search.search_tfidf(index, query).collect()}
    assert got == pytest.approx(want)
    assert order(search.search_tfidf(index, query, 3)) == sorted(want, key=lambda i: (-want[i], i))[:3]


def test_limits_and_unknown_words(spark):
    index = build(spark, ["pear fig", "fig"])
    assert order(search.search_tfidf(index, ["fig"], 0)) == []
    assert order(search.search_tfidf(index, ["nothing"])) == []
    assert order(search.search_tfidf(index, ["the"])) == []
    assert order(search.search_tfidf(index, ["fig"], 99)) == [0, 1]


def test_deleted_documents_are_no_hits(spark):
    index = build(spark, ["pear fig", "fig"]).delete("pear")
    assert order(search.search_tfidf(index, ["fig"])) == [1]
    assert order(search.search_tfidf(index, ["fig"], include_deleted=True)) == [0, 1]


def test_batch_equals_single_queries(spark):
    index = build(spark, ["pear fig", "fig fig lime", "lime pear", "plum"])
    queries = spark.createDataFrame([(1, ["pear", None, "fig"], 2), (2, ["lime"], None), (3, None, 5), (4, ["the"], 5)], "query_id int, keywords array<string>, top_k int")
    got = {}
    for r in search.search_batch(index, queries).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.key)
    assert got == {1: order(search.search_tfidf(index, ["pear", "fig"], 2)), 2: order(search.search_tfidf(index, ["lime"]))}


def batch(index, rows, id_type="int"):
    queries = index.spark.createDataFrame(rows, f"query_id {id_type}, keywords array<string>, top_k int")
    return [tuple(r) for r in search.search_batch(index, queries).orderBy("query_id", "place").collect()]


def single(index, rows):
    return [
        (q, *r, place)
        for q, words, k in rows
        for place, r in enumerate(search.search_tfidf(index, [w for w in words if w], k, digits=6).select("seg_id", "doc_id", "key", "score").collect(), 1)
    ]


def test_batch_by_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE_DOCS", 7)
    monkeypatch.setattr(search, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(scoring, "BATCH_ROWS", 5)
    random = Random(5)
    index = build(spark, [" ".join(random.choices(["oak", "elm", "ash", "yew", "fir"], k=random.randint(1, 9))) for _ in range(60)], 4).delete("fir")
    rows = [("a", ["oak", "elm", "oak"], None), ("b", ["ash"], None), ("c", ["ash", "yew", None, "oak", "nothing"], 9), ("d", ["elm"], 5), ("e", ["yew", "elm"], 0), ("f", ["nothing"], None)]
    want = single(index, rows)
    assert len(want) > 30
    assert batch(index, rows, "string") == want


def test_batch_of_nothing(spark):
    assert batch(build(spark, ["pear"]), []) == []
    assert batch(TextIndex.empty(spark), [(1, ["pear"], 3), (2, ["pear"], None)]) == []


def test_batch_does_not_write_its_hits(spark):
    index = build(spark, ["oak elm" if i % 3 else "oak elm elm" for i in range(300)], 50)
    rows = [(i, ["oak", "elm"], 2 if i % 4 else None) for i in range(40)]
    written = set(Path(scratch_root(spark)).rglob("*.parquet"))
    queries = spark.createDataFrame(rows, "query_id int, keywords array<string>, top_k int")
    assert search.search_batch(index, queries).count() == 30 * 2 + 10 * 300
    # 12,000 pairs of query and document, of which 3,060 are asked for.
    new = [str(p) for p in Path(scratch_root(spark)).rglob("*.parquet") if p not in written]
    assert sum(spark.read.parquet(p).count() for p in new) < 1500


def ranks(edges, nodes, steps, damping=0.85):
    x = dict.fromkeys(nodes, 1.0)
    out = {n: sum(s == n for s, d in edges) for n in nodes}
    for _ in range(steps):
        x = {n: 1 - damping + damping * sum(x[s] / out[s] for s, d in edges if d == n) for n in nodes}
    return x


def test_pagerank(spark):
    edges = [(0, 1), (0, 1), (0, 2), (1, 2), (2, 2), (3, 0)]
    dirty = [*edges, (0, None), (None, 1), (0, 77), (88, 1)]
    e = spark.createDataFrame(dirty, "src int, dst int")
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 4)], "node int")
    got = {r.node: r.score for r in graph.pagerank(e, n, 5, tolerance=None).collect()}
    assert got == pytest.approx(ranks(edges, range(5), 5))
    early = {r.node: r.score for r in graph.pagerank(e, n, 200).collect()}
    assert early == pytest.approx(ranks(edges, range(5), 200), abs=1e-4)
    assert [r.node for r in graph.ranked(graph.pagerank(e, n, 5)).collect()][:1] == [2]
    assert graph.best_node(graph.pagerank(e, n, 5)).first().node == 2


def test_hot_source_in_groups(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_PER_GROUP", 7)
    edges = [(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 60)] + [(3, 4), (3, 4)]
    e = spark.createDataFrame(edges, "src int, dst int")
    n = spark.createDataFrame([(i,) for i in range(61)], "node int")
    got = {r.node: r.score for r in graph.pagerank(e, n, 4, tolerance=None).collect()}
    assert got == pytest.approx(ranks(edges, range(61), 4))


def test_pagerank_of_nothing(spark):
    e = spark.createDataFrame([], "src int, dst int")
    n = spark.createDataFrame([], "node int")
    assert graph.pagerank(e, n, 3).count() == 0


def test_combined_rank(spark):
    index = build(spark, ["pear fig", "fig", "fig lime"])
    pr = spark.createDataFrame([(0, 1.0), (2, 5.0)], "node bigint, score double")
    plain = {r.key: r.score for r in search.search_tfidf(index, ["pear", "fig"]).collect()}
    assert {r.key: r.score for r in search.search_combined(index, ["pear", "fig"], pr, 0.0).collect()} == pytest.approx(plain)
    assert order(search.search_combined(index, ["fig"], pr, 1000.0)) == [2, 0, 1]
    assert order(search.search_combined(index, ["fig"], pr, 1000.0, top_k=99)) == [2, 0, 1]
