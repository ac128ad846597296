from collections import Counter

from verbarium.llm import words as words_module
from verbarium.llm.distinctive import distinctive_words
from verbarium.llm.term_counts import dictionary_words, radix_aggregate, term_bands, term_counts
from verbarium.llm.words import partial_counts, words

SCHEMA = "doc_id bigint, text string, term string, tf int, df int, part int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


TEXTS = ["Cat dog cat", "dog İstanbul K9", None, "", "  ", "cat-cat_cat", "dog " * 3000 + "bird", "cat dog", "cat dog", "long" * 5000]


def brute(texts):
    tf, df = Counter(), Counter()
    for t in texts:
        tf.update(words(t or ""))
        df.update(set(words(t or "")))
    return {t: (tf[t], df[t]) for t in tf}


def rows(df):
    return {r.term: (r.tf, r.df) for r in df.collect()}


def test_counts(spark):
    got = rows(term_counts(table(spark, TEXTS)))
    assert got.pop(None) == (0, 9)
    assert got == brute(TEXTS)


def test_oversized_partitions_are_split(spark, monkeypatch):
    texts = [f"w{i} w{i % 50} w{i % 7}" for i in range(600)]
    monkeypatch.setattr(words_module, "FLUSH_TERMS", 20)
    got = rows(radix_aggregate(partial_counts(table(spark, texts)), max_part_bytes=1500, first_bits=1))
    assert got.pop(None) == (0, 600)
    assert got == brute(texts)


def test_partition_beyond_the_memory_without_a_folder_to_spill_to(tmp_path):
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    from verbarium.llm.term_counts import aggregate_file

    n = 200_000
    terms = [None if i == 0 else f"{'long' * 40}{i}" for i in range(n)] + [f"{'long' * 40}{i}" for i in range(1, 1001)]
    pq.write_table(pa.table({"term": terms, "tf": [2] * len(terms), "df": [1] * len(terms)}), tmp_path / "p.parquet", compression="zstd", row_group_size=20_000)
    rows = ds.dataset(str(tmp_path), format="parquet")
    got = {}
    for batch in aggregate_file(rows, None, "40MB"):
        for t, tf, df in zip(*(batch.column(c).to_pylist() for c in ("term", "tf", "df"))):
            assert t not in got
            got[t] = (tf, df)
    assert got == {t: (4, 2) if t and int(t[160:]) <= 1000 else (2, 1) for t in terms}


def test_partitions_are_measured_uncompressed(spark, monkeypatch):
    texts = [f"{'a' * 500}{i}" for i in range(300)]
    from verbarium.llm import term_counts as module

    spilled = []
    real = module._spill
    monkeypatch.setattr(module, "_spill", lambda rows, bits, n: spilled.append(bits) or real(rows, bits, n))
    got = rows(radix_aggregate(partial_counts(table(spark, texts)), max_part_bytes=60_000, first_bits=1))
    assert len(got) == 301 and spilled == [1, 4]  # 300 terms of 500 bytes, which zstd writes in a few


def test_rows_of_one_term_are_not_split(spark, monkeypatch):
    from verbarium.llm import term_counts as module

    spilled = []
    real = module._spill
    monkeypatch.setattr(module, "_spill", lambda rows, bits, n: spilled.append(bits) or real(rows, bits, n))
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'one', if(id % 3 = 1, 'two', null)) AS term", "2L AS tf", "1L AS df")
    assert rows(radix_aggregate(df, max_part_bytes=100, first_bits=1)) == {"one": (2000, 1000), "two": (2000, 1000), None: (2000, 1000)}
    assert len(spilled) <= 8


def test_bands_and_dictionary(spark):
    lines = [("﻿ Cat　", "en"), ("cat", "en"), ("zebra", "en"), ("", "en"), ("﻿", "en"), (None, "en"), ("猫", "zh"), ("x", None)]
    listed = spark.createDataFrame(lines, "word string, lang string")
    assert {r.term for r in dictionary_words(listed).collect()} == {"cat", "zebra"}
    got = {r.term: (r.tf, r.df, r.band) for r in term_bands(term_counts(table(spark, TEXTS), listed)).collect()}
    assert got["zebra"] == (0, 0, "rare")
    assert got["cat"] == (7, 4, "common")
    assert got["bird"] == (1, 1, "rare")


def test_empty_table(spark):
    listed = spark.createDataFrame([("Cat", "en")], "word string, lang string")
    assert {tuple(r) for r in term_bands(term_counts(table(spark, []), listed)).collect()} == {("cat", 0, 0, "rare")}
    assert term_bands(term_counts(table(spark, []))).count() == 0
    assert distinctive_words(table(spark, [])).count() == 0


def test_common_is_strictly_more(spark):
    got = {r.term: r.band for r in term_bands(term_counts(table(spark, ["a b", "a b", "a b"] + ["a"] + ["c"] * 11))).collect()}
    assert got == {"a": "common", "b": "useful", "c": "common"}


def test_distinctive_words(spark):
    import math

    texts = [" ".join(f"w{(i * k) % 41}" for k in range(1, 60)) + (" rare rare" if i % 5 == 0 else "") for i in range(30)] + [None, "", "few words", "a b " * 500]
    texts += [texts[0]]
    n = sum(t is not None for t in texts)
    _, df = Counter(), Counter()
    for t in texts:
        df.update(set(words(t or "")))
    want = set()
    for i, t in enumerate(texts):
        tf = Counter(words(t or ""))
        if len(tf) < 20:
            continue
        scored = sorted((-round((1 + math.log10(c)) * math.log10(n / df[w]), 6), w) for w, c in tf.items() if df[w] >= 2)
        want |= {(i, w, -s) for s, w in scored[:3]}
    for head in (1, 5, 10_000):  # with most, some and none of the words in the joined tail
        got = {(r.doc_id, r.term, r.score) for r in distinctive_words(table(spark, texts), head_size=head).collect()}
        assert got == want


def test_repeated_keys_give_their_rows_each(spark):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(7, text), (7, text)], "doc_id bigint, text string")
    assert distinctive_words(df).count() == 6
