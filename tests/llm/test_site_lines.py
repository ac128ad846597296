import random
import re
from collections import Counter, defaultdict

import numpy as np

from verbarium.llm import site_lines
from verbarium.llm.site_lines import Summaries, repeated_line_numbers, without_repeated_lines
from verbarium.llm.words import MONTHS

SCHEMA = "doc_id bigint, text string, source string, forms string, key int, row int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def form(line):
    words = re.findall(r"[^\W\d_]+", line.lower())
    return "".join(w for w in words if w not in MONTHS)


def brute(rows, share=0.1, least=3):
    size, seen = Counter(), defaultdict(Counter)
    for _, text, source in rows:
        size[source] += 1
        for f in {form(x) for x in (text or "").split("\n")} - {""}:
            seen[source][f] += 1
    return {
        (d, i)
        for d, text, source in rows
        for i, x in enumerate((text or "").split("\n"), 1)
        if form(x) and seen[source][form(x)] >= max(least, share * size[source] - 1e-9)
    }


def sample(n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lines = [f"own line {chr(97 + rng.randrange(26))}{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(rng.randrange(6))]
        if rng.random() < 0.5:
            lines.append(rng.choice(["Share this page", "SHARE  this page!", "* share\xa0this page >>"]))
        if rng.random() < 0.3:
            lines.insert(0, f"Posted {rng.randrange(30)} {rng.choice(['May', 'june'])} 20{rng.randrange(10, 30)}")
        if rng.random() < 0.2:
            lines.append("12 | 34 --")
        rows.append((i, rng.choice(["\n", "\r\n"]).join(lines), "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])))
    rows += [(1000, None, "hot"), (1001, "", "a"), (1002, "Share this page\nshare this page", "tiny"), (1003, "\n\n", "hot")]
    rows += [(1004 + k, "same text\nnew", "three") for k in range(3)]
    return rows


def pairs(df):
    return {(r.doc_id, r.line_no) for r in df.collect()}


def test_lines_equal_brute_force(spark):
    rows = sample()
    assert pairs(repeated_line_numbers(table(spark, rows))) == brute(rows)


def test_few_counters_still_find_all(spark):
    rows = sample()
    assert pairs(repeated_line_numbers(table(spark, rows), counters=4)) == brute(rows)


def test_other_ways_for_large_sets(spark, monkeypatch):
    rows = sample(150)
    found = pairs(repeated_line_numbers(table(spark, rows)))
    cleaned = {tuple(r) for r in without_repeated_lines(table(spark, rows)).collect()}
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", 0)
    assert pairs(repeated_line_numbers(table(spark, rows))) == found
    assert {tuple(r) for r in without_repeated_lines(table(spark, rows)).collect()} == cleaned


def test_cleaned_texts(spark):
    rows = sample(150)
    found = brute(rows)
    want = {}
    for d, text, _ in rows:
        kept = [x for i, x in enumerate((text or "").split("\n"), 1) if (d, i) not in found]
        want[d] = (None if text is None else "\n".join(kept), sum(k == d for k, _ in found))
    assert {r.doc_id: (r.text, r.n_removed) for r in without_repeated_lines(table(spark, rows)).collect()} == want


def test_empty_table(spark):
    assert repeated_line_numbers(table(spark, [])).count() == 0
    assert without_repeated_lines(table(spark, [])).count() == 0


def test_long_text(spark):
    rows = [(i, "\n".join(f"line {chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(5000)) + "\nfoot", "s") for i in range(4)]
    assert pairs(repeated_line_numbers(table(spark, rows))) == {(i, 5001) for i in range(4)}


def test_summary_bounds():
    rng = np.random.default_rng(0)
    s, exact = Summaries(10), Counter()
    for _ in range(50):
        part = rng.zipf(1.5, 100)
        s.add("x", part)
        exact.update(part.tolist())
    keys, counts, error = s.state["x"]
    kept = dict(zip(keys.tolist(), counts.tolist()))
    assert len(kept) <= 10 and error <= 5000 / 11
    for value, n in exact.items():
        assert kept.get(value, 0) <= n <= kept.get(value, 0) + error
