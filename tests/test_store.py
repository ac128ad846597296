import pytest

from verbarium.sources.docstore import DocStore, latest
from verbarium.sources.files import page_parts, read_corpus, read_dictionary, read_links, read_urls, write_corpus, write_lines
from verbarium.streaming.ingest import ingest, open_stream_index


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    store = DocStore.bulk_load(docs(spark, [(2, "b"), (1, "a"), (3, "c")]), path)
    store.add(docs(spark, [(2, "B"), (4, "d")]))
    assert [tuple(r) for r in store.iterate().collect()] == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert [r.text for r in store.get(2).collect()] == ["B"]
    assert store.get(99).count() == 0
    assert [r.doc_id for r in store.keys().collect()] == [1, 2, 3, 4]
    assert store.size() == 4
    with pytest.raises(PermissionError):
        DocStore.open_read_only(spark, path).add(docs(spark, [(5, "e")]))


def test_latest_with_nulls_and_ties(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, None, 5), (2, "x", None), (None, "n", 1)]
    got = latest(spark.createDataFrame(rows, "k int, t string, v int"), "k", "v").collect()
    assert {(r.k, r.t, r.v) for r in got} == {(1, "c", 2), (2, None, 5), (None, "n", 1)}


def test_files(spark, tmp_path):
    folder = tmp_path / "cleaned"
    folder.mkdir()
    (folder / "10").write_text("10\nhttp://a.example/x\nbody one\nbody two", encoding="utf-8")
    (folder / "2").write_text("2\nhttp://b.example/y", encoding="utf-8")
    (folder / "notes.txt").write_text("no page")
    pages = read_corpus(spark, str(tmp_path))
    assert sorted(r.page_id for r in pages.collect()) == [2, 10]
    assert {tuple(r) for r in page_parts(pages).collect()} == {(10, "http://a.example/x", "body one\nbody two"), (2, "http://b.example/y", "")}
    (tmp_path / "g.tsv").write_text("1\t2\n1 3\n\n")
    assert {tuple(r) for r in read_links(spark, str(tmp_path / "g.tsv")).collect()} == {(1, 2), (1, 3), (None, None)}
    (tmp_path / "u.tsv").write_text("1\thttp://a\n")
    assert [tuple(r) for r in read_urls(spark, str(tmp_path / "u.tsv")).collect()] == [(1, "http://a")]
    (tmp_path / "d.txt").write_text("﻿cat 3\ndog 2.5\n", encoding="utf-8")
    assert {tuple(r) for r in read_dictionary(spark, str(tmp_path / "d.txt"), "en").collect()} == {("cat", 3.0, "en"), ("dog", 2.5, "en")}


def test_written_files_come_back(spark, tmp_path):
    texts = [(7, "7\nhttps://a.example/x\r\nbody \" 字\n"), (8, ""), (9, None), (None, "x")]
    folder = str(tmp_path / "crawl")
    assert write_corpus(spark.createDataFrame(texts, "page_id bigint, text string"), folder) == 2
    assert {(r.page_id, r.text) for r in read_corpus(spark, folder).collect()} == {(7, texts[0][1])}  # an empty file gives no page
    rows = [(1, 'https://a.example/"q"'), (2, None), (None, "https://b.example")]
    path = str(tmp_path / "urls")
    write_lines(spark.createDataFrame(rows, "id int, url string"), path, "id", "url")
    assert {tuple(r) for r in read_urls(spark, path).collect()} == set(rows)


def test_stream_ingest(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    docs(spark, [(1, "cat dog"), (2, "dog")]).write.parquet(source)

    def run():
        ingest(spark.readStream.schema("doc_id bigint, text string").parquet(source), path, state, per_segment=1).awaitTermination()

    run()
    docs(spark, [(3, "cat")]).write.mode("append").parquet(source)
    run()
    run()
    index = open_stream_index(spark, path)
    assert sorted(r.key for r in index.documents.collect()) == [1, 2, 3]
    assert index.n_segments() == 3
    assert index.postings.filter("term = 'cat'").count() == 2


def test_deletions_of_a_streamed_index_stay(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    docs(spark, [(1, "heron pond"), (2, "pond"), (3, "heron")]).write.parquet(source)

    def run():
        ingest(spark.readStream.schema("doc_id bigint, text string").parquet(source), path, state, per_segment=2).awaitTermination()
        return open_stream_index(spark, path)

    run().delete("heron")
    assert sorted(r.key for r in open_stream_index(spark, path).live().collect()) == [2]
    docs(spark, [(4, "heron reed")]).write.mode("append").parquet(source)
    index = run()
    assert sorted(r.key for r in index.live().collect()) == [2, 4]
    assert {(r.seg_id, r.n_docs) for r in index.segments().collect()} == {(0, 2), (1, 1), (2, 1)}
    # Segments are folders of a batch, not folders of their own.
    assert sorted(p.name for p in (tmp_path / "index" / "documents").iterdir() if p.is_dir()) == ["batch=0", "batch=2"]


def test_large_batch_leaves_the_next_one_whole(spark, tmp_path, monkeypatch):
    source, path, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    # Segments that a batch might once have: the first batch has more.
    monkeypatch.setattr("verbarium.streaming.ingest.BATCH_SEGMENTS", 2, raising=False)

    def run():
        ingest(spark.readStream.schema("doc_id bigint, text string").parquet(source), path, state, per_segment=1).awaitTermination()
        index = open_stream_index(spark, path)
        return sorted(r.key for r in index.documents.collect()), index.postings.filter("term = 'cat'").count()

    docs(spark, [(i, "cat") for i in range(4)] + [(9, None)]).write.parquet(source)
    assert run() == ([0, 1, 2, 3], 4)
    docs(spark, [(i, "cat") for i in range(4, 7)]).write.mode("append").parquet(source)
    assert run() == (list(range(7)), 7)
    for name in ("1", ".1.crc"):  # the last batch runs again
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    assert run() == (list(range(7)), 7)


def test_store_queries_use_the_store(spark, tmp_path, monkeypatch):
    from verbarium.plans import reference

    docs(spark, [(3, "cat"), (1, "dog"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    used = []
    for name in ("bulk_load", "scan", "get", "keys", "size"):
        real = getattr(DocStore, name)
        monkeypatch.setattr(DocStore, name, lambda *a, _real=real, _name=name: used.append(_name) or _real(*a))
    got = {q: [tuple(r) for r in getattr(reference, f"docstore_{q}")(spark, str(tmp_path)).collect()] for q in ("scan", "get", "keys", "size")}
    assert sorted(got["scan"]) == [(1, "dog"), (3, "cat")]
    assert (got["get"], got["keys"], got["size"]) == ([(1, "dog")], [(1,), (2,), (3,)], [(3,)])
    assert used.count("bulk_load") == 1
    assert {"scan", "get", "keys", "size"} <= set(used)
