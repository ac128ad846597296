import random
from itertools import combinations

import numpy as np
import pytest

from verbarium.llm import near_dup
from verbarium.llm.near_dup import choose_matches, equal_texts, similar_groups, similar_pairs
from verbarium.llm.words import words

SCHEMA = "doc_id bigint, text string, key int, size int, a int, b int, class string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def edited(rng, text, share):
    out = []
    for w in text.split():
        r = rng.random()
        if r < share / 3:
            continue
        out.append(f"new{rng.randrange(900)}" if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append("put")
    return " ".join(out)


def sample(seed=2, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 160)))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            rows.append(edited(rng, base, rng.choice([0.01, 0.05, 0.1, 0.2])))
        if rng.random() < 0.3:
            rows.append(base.upper().replace(" ", "  "))
        if rng.random() < 0.2:  # half of it, twice as long
            rows.append(base[: len(base) // 2])
    return [(i * 3, t) for i, t in enumerate(rows)] + [(5000, None), (5001, ""), (5002, "too short"), (5003, "same " * 400)]


def brute(rows, width, threshold, least):
    sets = {}
    for d, t in rows:
        w = words(t or "")
        if len(w) >= max(least, width):
            sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def pairs(df):
    return {(r.doc_id_a, r.doc_id_b) for r in df.collect()}


@pytest.mark.parametrize(("width", "threshold", "least"), [(3, 0.5, 40), (5, 0.8, 0), (2, 0.3, 10)])
def test_pairs_equal_brute_force(spark, width, threshold, least):
    rows = sample()
    got = similar_pairs(table(spark, rows), width=width, threshold=threshold, min_words=least)
    assert pairs(got) == brute(rows, width, threshold, least)
    assert got.count() == len(pairs(got))


def test_small_sketch_and_joined_filters_lose_nothing(spark, monkeypatch):
    rows = sample(4, 40)
    monkeypatch.setattr(near_dup, "SKETCH_BITS", 16)  # all counts collide
    monkeypatch.setattr(near_dup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(near_dup, "FLUSH_POSTINGS", 500)
    monkeypatch.setattr(near_dup, "RANGE_BYTES", 1000)
    assert pairs(similar_pairs(table(spark, rows), width=3, threshold=0.5, min_words=20)) == brute(rows, 3, 0.5, 20)


def test_hot_shingles_in_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(90))
    rows = [(i, edited(rng, base, 0.06)) for i in range(60)] + sample(7, 20)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows, 3, 0.5, 40)
    assert len(want) > 900
    monkeypatch.setattr(near_dup, "HOT_BLOCK", 7)
    assert pairs(similar_pairs(table(spark, rows), width=3, threshold=0.5, min_words=40)) == want


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(3)
    texts = ["İstanbul K9 straße ΟΔΟΣ x", "", "!?", "a" * 999 + " b", " ".join(rng.choice(["cat", "Dog", "字", "w1", "éa", "z" * 70]) for _ in range(400)), "q" * 300]
    for size in (1 << 20, 64, 7, 1):
        monkeypatch.setattr(near_dup, "HASH_BYTES", size)
        seen = {}
        for t in texts:
            data = np.frombuffer(t.lower().encode(), dtype=np.uint8)
            starts, hashes = near_dup.word_hashes(data)
            found = words(t)
            assert len(found) == len(hashes)
            for w, x, at in zip(found, hashes.tolist(), starts.tolist()):
                assert data[at : at + len(w)].tobytes().decode() == w
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_sets_of_a_batch_are_those_of_its_texts():
    rows = sample(5, 20)
    texts = [t or "" for _, t in rows]
    for width, least in ((3, 40), (1, 0), (5, 0)):
        s, bounds, used = near_dup.shingle_sets(texts, width, least)
        one = {i: x.tolist() for i, t in enumerate(texts) if (x := near_dup.shingles(t, width, least)) is not None}
        assert {int(i): s[a:b].tolist() for i, a, b in zip(used, bounds, bounds[1:])} == one


def test_counters_hold_any_count_and_a_full_sketch_tells_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SKETCH_BITS", 6)
    monkeypatch.setattr(near_dup, "FLUSH_SHINGLES", 1000)
    # 140,000 documents of one word out of 64 * 1,000 and one that all have.
    df = spark.range(0, 140_000, 1, 2).selectExpr("id AS key", "concat('common w', id % 64000) AS text")
    first, _ = near_dup._first_pass(df, 1, 0)
    q = near_dup._sketch(first)
    common = int(near_dup.shingles("common", 1, 0)[0] >> np.uint64(58))
    most = near_dup.counted_at_most(q)
    assert 138_000 <= most[common] <= 170_000
    # The others have 2,200 documents a counter, but no shingle of theirs is taken for one of as many.
    assert max(np.delete(most, common)) < 700 and q.max() == q[common]


def test_blocks_pair_every_two_documents_once():
    q = near_dup.written_count(np.array([3, 60_000, 60_000, 40]))
    tok = np.array([1, 2, 3, 4], dtype=np.uint64)
    seen = {}
    for key in range(200):
        for t, p in zip(*near_dup.split_hot(tok, q, np.arange(4), key, 16)):
            seen.setdefault(int(t), []).append((key, int(p) >> 2, int(p) & 3))
    met = {}
    for members in seen.values():
        for (a, i, m), (b, j, n) in combinations(members, 2):
            if i == j and a != b and (m == 0 or m != n):
                met[i, a, b] = met.get((i, a, b), 0) + 1
    assert set(met.values()) == {1}
    assert len(met) == 4 * 199 * 100
    assert max(map(len, seen.values())) <= 200


def test_large_class_of_copies_is_a_star(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    near = edited(rng, base, 0.05)
    rows = [(i, base) for i in range(10, 40)] + [(1, near), (2, " ".join(f"u{i}" for i in range(80)))]
    got = pairs(similar_pairs(table(spark, rows), width=3, threshold=0.5, full_class=5))
    assert got == {(10, i) for i in range(11, 40)} | {(1, 10)}
    groups = {r.doc_id: (r.group_id, r.n_links) for r in similar_groups(table(spark, rows), width=3, threshold=0.5).collect()}
    assert groups == {**{i: (1, 1) for i in range(10, 40)}, 1: (1, 1), 2: (2, 0)}


def test_large_class_is_written_in_full(spark, monkeypatch):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    near = edited(rng, base, 0.05)
    # One class of 120 by its shingles, of two texts; and one of 3 that matches it.
    rows = [(i, base if i % 2 else base.replace(" ", ", ", 9)) for i in range(10, 130)] + [(i, near) for i in range(3)]
    want = set(combinations(range(3), 2)) | set(combinations(range(10, 130), 2)) | {(a, b) for a in range(3) for b in range(10, 130)}
    assert brute(rows, 3, 0.5, 40) == want
    for block in (128, 7):
        monkeypatch.setattr(near_dup, "PAIR_BLOCK", block)
        got = similar_pairs(table(spark, rows), width=3, threshold=0.5, min_words=40)
        assert pairs(got) == want
        assert got.count() == len(want)
    # As stars, the two texts keep their link with each other and with the near copies.
    got = pairs(similar_pairs(table(spark, rows), width=3, threshold=0.5, min_words=40, full_class=5))
    stars = {(10 + i % 2, i) for i in range(12, 130)}
    assert got == stars | {(10, 11)} | set(combinations(range(3), 2)) | {(a, b) for a in range(3) for b in (10, 11)}
    assert {(r.copy_of, r.doc_id) for r in equal_texts(table(spark, rows)).collect()} == stars | {(10, 10), (11, 11), (0, 0), (0, 1), (0, 2)}


def test_groups_are_components(spark):
    rows = sample(6, 30)
    got = {r.doc_id: r.group_id for r in similar_groups(table(spark, rows), width=3, threshold=0.5, min_words=40).collect()}
    parent = {d: d for d, t in rows if len(words(t or "")) >= 40}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 3, 0.5, 40):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {d: root(d) for d in parent}


def test_empty_table_and_repeated_rows(spark):
    assert similar_pairs(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    assert pairs(similar_pairs(table(spark, [(1, text), (1, text), (2, text)]))) == {(1, 2)}


def test_cost_asks_for_more_when_shingles_are_common():
    assert choose_matches(np.ones(200, dtype=np.uint8), 101) == 1
    assert choose_matches(np.full(200, 50, dtype=np.uint8), 101) > 4


@pytest.mark.parametrize("n", [1, 3, 16, 40])
def test_ranges_are_dealt_evenly(spark, n):
    labels = near_dup._even_labels(spark, n)
    df = spark.createDataFrame([(x,) for x in labels], "to int").repartition(n, "to")
    assert sorted(df.groupBy(near_dup.F.spark_partition_id()).count().collect()) == [(i, 1) for i in range(n)]
