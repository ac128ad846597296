from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from verbarium.llm.packing import pack, plan


def used(patterns):
    out = Counter()
    for p, n in patterns:
        for s in p:
            out[s] += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=30))
def test_plan_places_every_item_once(counts):
    patterns = plan(counts, 40)
    assert all(sum(p) <= 40 and n > 0 for p, n in patterns)
    assert used(patterns) == Counter(counts)
    # At most one container of two can be half empty or less.
    assert sum(n for p, n in patterns if sum(p) <= 20) <= 1


def test_exact_complements():
    assert dict(plan({100: 2, 60: 3, 40: 3}, 100)) == {(100,): 2, (60, 40): 3}
    assert dict(plan({50: 4, 30: 2, 20: 2}, 100)) == {(50, 50): 2, (30, 30, 20, 20): 1}
    assert sum(n for _, n in plan({55: 10, 25: 10, 20: 10}, 100)) == 10


def test_plan_does_not_grow_with_the_items():
    few = plan({s: 3 for s in range(1, 500)}, 2048)
    many = plan({s: 3_000_000 for s in range(1, 500)}, 2048)
    assert len(many) < 20_000 and len(few) < 20_000


def check(rows, sizes, capacity):
    load, parts = Counter(), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.n
        parts[r.key].append((r.part_no, r["first"], r.n))
    assert all(n <= capacity for n in load.values())
    assert set(load) == set(range(len(load)))
    for key, size in sizes.items():
        p = sorted(parts.pop(key, []))
        assert [x[0] for x in p] == list(range(len(p)))
        assert [x[1] for x in p] == [capacity * i for i in range(len(p))]
        assert sum(x[2] for x in p) == max(size or 0, 0)
        assert len(p) == -(-max(size or 0, 0) // capacity)
    assert not parts
    return len(load)


def test_pack(spark):
    sizes = {i: (i * 37) % 90 + 1 for i in range(500)} | {1000: 0, 1001: None, 1002: 250, 1003: 100, 1004: 300} | {2000 + i: 33 for i in range(300)}
    df = spark.createDataFrame([(k, n, 1, 2, 3) for k, n in sizes.items()], "key bigint, n bigint, size int, part int, part_no int")
    n = check(pack(df, "key", "n", 100).collect(), sizes, 100)
    total = sum(max(s or 0, 0) for s in sizes.values())
    assert n <= 1.02 * total / 100 + 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 60), (1, 60), (1, 40)], "key bigint, n bigint")
    rows = pack(df, "key", "n", 100).collect()
    assert sorted(r.n for r in rows) == [40, 60, 60] and len({r.container_id for r in rows}) == 2
    assert pack(df.limit(0), "key", "n", 100).count() == 0
