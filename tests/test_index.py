import random

import pytest
from pyspark.sql import functions as F

from verbarium.functions.porter import stem_tokens
from verbarium.functions.register import register
from verbarium.functions.text import analyzer, tokenize_naive, tokenize_punctuation
from verbarium.operators import search
from verbarium.operators.index import IndexWriter, TextIndex

PLAIN = analyzer(tokenize_punctuation)
STEMMED = analyzer(tokenize_punctuation, stem_tokens)
NAIVE = analyzer(tokenize_naive)


def build(spark, texts, per_segment=1000, analyze=PLAIN, positional=True):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return TextIndex.build(docs, analyze=analyze, per_segment=per_segment, positional=positional)


def keys(df):
    return sorted(r.key for r in df.collect())


def dump(index, seg=0):
    return {r.term: (r.doc_ids, r.positions) for r in index.dump(seg).collect()}


def test_positional_dump_and_merge(spark):
    index = build(spark, ["oak elm oak", "ash elm", "yew"], per_segment=2)
    assert index.n_segments() == 2
    assert dump(index, 0)["oak"] == ([0], [[0, 2]])
    assert dump(index, 1) == {"yew": ([0], [[0]])}
    merged = index.merge_pairs()
    got = dump(merged)
    assert merged.n_segments() == 1
    assert got == {"oak": ([0], [[0, 2]]), "elm": ([0, 1], [[1], [1]]), "ash": ([1], [[0]]), "yew": ([2], [[0]])}


def test_repeated_words(spark):
    got = dump(build(spark, ["elm oak elm", "yew the yew of yew", "elm"]))
    assert got["elm"] == ([0, 2], [[0, 2], [0]])
    assert got["yew"] == ([1], [[0, 1, 2]])  # stop words have no place


def test_document_frequencies_and_merge(spark):
    texts = ["brass bells", "bell tower", "tower", "the bells", "Tower, bells", "brass"]
    index = build(spark, texts, per_segment=2, analyze=STEMMED)
    assert [index.document_frequency(s, "bell") for s in (0, 1, 2)] == [2, 1, 1]
    assert [index.document_frequency(s, "tower") for s in (0, 1, 2)] == [1, 1, 1]
    assert index.document_frequency(1, "brass") == 0
    with pytest.raises(ValueError):
        index.document_frequency(9, "bell")
    with pytest.raises(ValueError):
        index.merge_pairs()
    six = build(spark, texts, per_segment=1, analyze=STEMMED)
    before = six.document_frequencies().groupBy("term").agg(F.sum("df")).collect()
    after = six.merge_pairs().document_frequencies().groupBy("term").agg(F.sum("df")).collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))


def test_thresholds(spark):
    texts = [f"leaf number{i}" for i in range(28)]
    index = build(spark, texts[:21], per_segment=7)
    assert [index.n_documents(i) for i in range(3)] == [7, 7, 7]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts[21:])], "doc_id bigint, text string")
    assert index.flush(more, per_segment=7, merge_at=5).n_segments() == 4
    grown = index.flush(more, per_segment=7, merge_at=4)
    assert sorted(r.n_docs for r in grown.segments().collect()) == [14, 14]
    with pytest.raises(ValueError):
        index.n_documents(7)


def test_empty_documents_keep_their_number(spark):
    index = build(spark, ["", "cat", "!!", "cat"])
    assert dump(index)["cat"][0] == [1, 3]
    assert index.n_documents(0) == 4


def test_null_texts_and_empty_tables(spark):
    index = build(spark, [None, "cat", None])
    assert keys(search.search_keyword(index, "cat")) == [1]
    empty = TextIndex.empty(spark)
    assert empty.n_segments() == 0
    assert search.search_keyword(empty, "cat").count() == 0
    assert search.search_tfidf(empty, ["cat"]).count() == 0


def test_repeated_keys_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "cat"), (1, "cat"), (2, "dog")], "doc_id bigint, text string")
    index = TextIndex.build(docs, analyze=PLAIN)
    assert sorted(r.doc_id for r in index.documents.collect()) == [0, 1, 2]
    assert keys(search.search_keyword(index, "cat")) == [1, 1]


def test_delete_then_merge_keeps_other_postings(spark):
    texts = ["fern moss", "moss", "reed", "fern", "reed moss", "reed", "fern reed", "moss reed"]
    index = build(spark, texts, per_segment=4, analyze=STEMMED)
    dead = index.delete("ferns")
    assert keys(dead.live()) == [1, 2, 4, 5, 7]
    assert keys(search.search_keyword(dead, "fern")) == []
    merged = dead.merge_pairs()
    got = dump(merged)
    assert {t: d for t, (d, _) in got.items()} == {"moss": [0, 2, 4], "reed": [1, 2, 3, 4]}
    assert merged.n_documents(0) == 5
    assert index.delete("the").tombstones.count() == 0
    assert index.delete("").tombstones.count() == 0


def test_save_and_open(spark, tmp_path):
    index = build(spark, ["cat dog", "dog"], per_segment=1).delete("cat")
    path = str(tmp_path / "index")
    index.save(path)
    again = TextIndex.open(spark, path, PLAIN)
    assert again.positional and again.n_segments() == 2
    assert keys(search.search_keyword(again, "dog")) == [1]
    plan = again.postings.filter("seg_id = 1 and term = 'dog'").select("tf")._jdf.queryExecution().toString()
    assert "EqualTo(seg_id,1)" in plan and "EqualTo(term,dog)" in plan


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_stored_index_keeps_its_catalogue_and_deletions(spark, tmp_path):
    path = tmp_path / "index"
    index = build(spark, ["fern moss", "moss", "reed"], per_segment=2).save(str(path))
    before = files(path)
    grown = index.append(spark.createDataFrame([(7, "fern"), (8, None), (9, "fern reed"), (10, "moss")], "doc_id bigint, text string"), per_segment=2)
    after = files(path)
    assert all(after[f] == t for f, t in before.items())  # what was there isn't written again
    assert {(r.seg_id, r.n_docs) for r in grown.segments().collect()} == {(0, 2), (1, 1), (2, 2), (3, 1)}
    assert keys(search.search_keyword(grown, "fern")) == [0, 7, 9]
    grown.delete("reed").delete("reed")
    again = TextIndex.open(spark, str(path), PLAIN)
    assert keys(search.search_keyword(again, "fern")) == [0, 7]
    assert again.tombstones.count() == 2 and again.n_documents(1) == 1
    # A merge leaves a segment without documents in the catalogue, and numbers without gaps.
    merged = again.delete("fern").merge_pairs()
    assert {(r.seg_id, r.n_docs) for r in merged.segments().collect()} == {(0, 1), (1, 1)}
    assert {(r.seg_id, r.doc_id, r.key) for r in merged.documents.collect()} == {(0, 0, 1), (1, 0, 10)}
    with pytest.raises(ValueError):
        merged.append(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))


def test_merge_with_and_without_deletions_equals_rebuilding(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["elm", "oak", "yew", "fir", "ash"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts[3] = texts[17] = "rowan oak"
    index = build(spark, texts, per_segment=5).delete("rowan")
    kept = [i for i in range(40) if i not in (3, 17)]
    merged = index.merge_pairs()
    assert {(r.seg_id, r.key) for r in merged.documents.collect()} == {(i // 10, i) for i in kept}
    for seg in range(4):
        place = {i: k for k, i in enumerate(i for i in kept if i // 10 == seg)}
        want = {}
        for i in place:
            for pos, w in enumerate(texts[i].split()):
                want.setdefault(w, {}).setdefault(place[i], []).append(pos)
        assert dump(merged, seg) == {w: (list(d), list(d.values())) for w, d in want.items()}


def test_and_or(spark):
    index = build(spark, ["rye wheat", "oats", "wheat barley rye ", "rye"], analyze=NAIVE)
    assert keys(search.search_and(index, ["wheat", "rye"])) == [0, 2]
    assert keys(search.search_and(index, ["rye", "rye"])) == [0, 2, 3]
    assert keys(search.search_and(index, ["wheat", "oats"])) == []
    assert keys(search.search_or(index, [""])) == []
    assert keys(search.search_or(index, ["oats", "barley"])) == [1, 2]


def test_search_equals_full_scan(spark):
    texts = ["boats and sails", "a sail", "sailing boats", None, "", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    index = TextIndex.build(docs, analyze=STEMMED)
    for query in ("sail boat", "sails", "the", ""):
        scan = sorted(r.doc_id for r in search.full_scan(docs, query, STEMMED).collect())
        assert keys(search.search_keyword(index, query)) == scan


def test_phrases(spark):
    # Next to each other, with stop words or marks between, apart, in the other order.
    texts = ["the quiet harbours", "quiet, and the HARBOUR", "quiet boats in a harbour", "a harbour so quiet", "harbour quietly: quiet harbour"]
    index = build(spark, texts, analyze=STEMMED, per_segment=2)
    assert keys(search.search_phrase(index, ["quiet", "harbour"])) == [0, 1, 4]
    assert keys(search.search_phrase(index, ["Quiet the harbours"])) == [0, 1, 4]
    assert keys(search.search_phrase(index, [])) == []
    assert keys(search.search_phrase(index, ["harbour"])) == [0, 1, 2, 3, 4]
    assert keys(search.search_phrase(index.delete("boats"), ["harbour"])) == [0, 1, 3, 4]


def test_phrase_at_any_place_and_repeated_words(spark):
    index = build(spark, ["tick off tick tock", "tick tock", "tick tick", "tock"], analyze=NAIVE)
    assert keys(search.search_phrase(index, ["tick", "tock"])) == [0, 1]
    assert keys(search.search_phrase(index, ["tick", "tick"])) == [2]


def test_equal_copies_are_all_found(spark):
    index = build(spark, ["one lamp above the old pier"] * 8, per_segment=1)
    while index.n_segments() > 1:
        index = index.merge_pairs().cached()
    assert len(keys(search.search_phrase(index, ["lamp", "above", "the", "old"]))) == 8


def test_phrase_needs_positions(spark):
    index = build(spark, ["cat"], positional=False)
    with pytest.raises(NotImplementedError):
        search.search_phrase(index, [])


def test_writer_flushes_and_merges_by_itself(spark):
    writer = IndexWriter(TextIndex.empty(spark, analyze=PLAIN), flush_docs=2, merge_at=4)
    sizes = []
    for i in range(9):
        writer.add(spark.createDataFrame([(i, f"cat number{i}")], "doc_id bigint, text string"))
        sizes.append(sorted(r.n_docs for r in writer.index.segments().collect()))
    assert sizes == [[], [2], [2], [2, 2], [2, 2], [2, 2, 2], [2, 2, 2], [4, 4], [4, 4]]
    assert keys(search.search_keyword(writer.index, "cat")) == list(range(8))
    writer.flush()
    writer.flush()
    assert keys(search.search_keyword(writer.index, "cat")) == list(range(9))


def test_a_flush_writes_its_own_segments_only(spark):
    writer = IndexWriter(TextIndex.empty(spark, analyze=PLAIN), flush_docs=3, merge_at=None)
    from pathlib import Path

    seen, grown = {}, []
    for i in range(4):
        writer.add(spark.createDataFrame([(10 * i + k, f"leaf branch{k}") for k in range(3)], "doc_id bigint, text string"))
        now = files(Path(writer.index.path))
        assert all(now[f] == t for f, t in seen.items())
        grown.append(len(now) - len(seen))
        seen = now
    assert len(set(grown[1:])) == 1
    assert writer.index.n_segments() == 4 and len(keys(search.search_keyword(writer.index, "leaf"))) == 12


def test_sql(spark):
    register(spark)
    index = build(spark, ["the cats", "cat dog"], analyze=STEMMED)
    index.create_views("t")
    rows = spark.sql("SELECT doc_id FROM t_postings WHERE term = stem_word('cats') ORDER BY doc_id").collect()
    assert [r.doc_id for r in rows] == [0, 1]
    assert spark.sql("SELECT stem_tokens(array('movies', 'cats'))").first()[0] == ["movi", "cat"]


def test_random_queries_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["ant", "bee", "cat", "dog", "elk", "fox"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(150)]
    index = build(spark, texts, per_segment=20).delete("fox").cached()
    live = {i: t.split() for i, t in enumerate(texts) if "fox" not in t.split()}
    for _ in range(6):
        query = [rng.choice(words[:5]) for _ in range(rng.randrange(1, 4))]
        n = len(query)
        assert keys(search.search_and(index, query)) == sorted(i for i, t in live.items() if set(query) <= set(t))
        assert keys(search.search_or(index, query)) == sorted(i for i, t in live.items() if set(query) & set(t))
        assert keys(search.search_phrase(index, query)) == sorted(i for i, t in live.items() if any(t[k : k + n] == query for k in range(len(t))))
