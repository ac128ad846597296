from verbarium.llm.truncation import length_spikes, text_ends, truncated, truncation_rates

SCHEMA = "doc_id bigint, text string, source string, key int, form string, cut int, hash int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


PROSE = "The old lantern near the hall still keeps a quiet list of {0} things, and the {0} reader counts them. "


def rows():
    out = []
    for i in range(40):  # a field of 190 characters
        out.append((i, (PROSE.format(f"w{i}") * 4)[: 190 if i % 2 else 150 - i] if i % 2 else PROSE.format(f"w{i}").strip(), "limited"))
    endings = {
        100: ("A whole sentence.", False), 101: ("It stops in the mid", True), 102: ("It stops here, and", True), 103: ("Ends with a mark of a c…", True),
        104: ("The server was […]", True), 105: ("Half a word th [...]  \n", True), 106: ("A sentence. ...", False), 107: ("半个句子在这里结束了的时候", True),
        108: ("一个完整的句子。", False), 109: ("Two points:\n• first\n• second item", False), 110: ("Steps\n1. open\n2. close it", False), 111: ("See\nhttps://x.example/a/b", False),
        112: ("Code\nreturn [f(t) for t in doc.x]", False), 113: ("Code\nx.flush(y); // y", False), 114: ("Text.\n-- A. Name, some desk", False), 115: ("Bytes were lost �", True),
        116: (None, False), 117: ("", False), 118: (" \n\t", False), 119: ("Text.\nFollow us for more", False), 120: ("$ tool --all", False), 121: ("Words " * 20000 + "end", True),
        122: ("Mail me at a.b@c.example", False),
    }
    out += [(k, t, "mixed") for k, (t, _) in endings.items()]
    out += [(200 + k, f"Start {k}.\nFollow us for more\nLast line {k}.", "other") for k in range(2)]
    return out, {k for k, (_, c) in endings.items() if c} | {i for i in range(40) if i % 2}


def test_cut_texts(spark):
    data, want = rows()
    assert {r.doc_id for r in truncated(table(spark, data)).filter("cut").collect()} == want


def test_spikes(spark):
    data, _ = rows()
    assert {(r.source, r.measure, r.high) for r in length_spikes(text_ends(table(spark, data))).filter("measure = 'chars'").collect()} == {("limited", "chars", 190)}


def test_equal_copies_are_no_spike(spark):
    data = [(i, "A long text that was copied without an end", "s") for i in range(5)] + [(9, "Short one.", "s")]
    assert length_spikes(text_ends(table(spark, data))).count() == 0


def test_byte_limit(spark):
    # 20 texts cut at 90 bytes, some in the middle of a character
    data = [(i, ("字" * (10 + i) + "ab" * i + "字" * 60).encode()[: 90].decode(errors="replace"), "s") for i in range(8)]
    data += [(100 + i, "好" * (3 + i) + "。", "s") for i in range(8)]
    assert {r.doc_id for r in truncated(table(spark, data)).filter("cut").collect()} == set(range(8))


def test_site_line_at_the_end_is_whole(spark):
    data = [(i, f"Text number {i} is here.\n{('back to top', 'BACK  to top', '* Back to top')[i % 3]}", "s") for i in range(30)]
    assert truncated(table(spark, data)).filter("cut").count() == 0


def test_copies_of_a_cut_text_are_one_witness(spark):
    cut = "A first line.\nIt was copied and stops in the mid"
    data = [(i, cut, "s") for i in range(3)] + [(3, cut + "…", "s")] + [(10 + i, f"Text number {i} is here.", "s") for i in range(6)]
    # The same unfinished line with another one after it, in copies of one text.
    data += [(20, "Once more.\nThe reader of the lantern counts", "t")] + [(21 + i, "The reader of the lantern counts\nthem all.", "t") for i in range(3)]
    assert {r.doc_id for r in truncated(table(spark, data)).filter("cut").collect()} == {0, 1, 2, 3, 20}
    assert {r.source: r.n_cut for r in truncation_rates(table(spark, data)).collect()} == {"s": 4, "t": 1}


def test_cut_at_a_spike_in_a_line_without_letters(spark):
    data = [(i, (PROSE.format(f"w{i}") * 4)[:187] + ("\n20", "\n -", "abc")[i % 3], "s") for i in range(12)] + [(50 + i, PROSE.format(f"w{i}")[: 60 + i] + "\n20", "s") for i in range(12)]
    assert {r.doc_id for r in truncated(table(spark, data)).filter("cut").collect()} == set(range(12))


def test_rates(spark):
    data = [(1, "whole.", "a"), (2, "cut in th", "a"), (3, None, "a"), (4, "", "b"), (5, "whole.", None)]
    got = {r.source: (r.n_texts, r.n_cut, r.share) for r in truncation_rates(table(spark, data)).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0), None: (1, 0, 0.0)}


def test_empty_table(spark):
    assert truncated(table(spark, [])).count() == truncation_rates(table(spark, [])).count() == 0


def test_what_is_usual_is_learned_by_source(spark):
    # Verse has no ends, and this desk signs with a word; the same endings are cuts where lines like them have ends.
    verse = [(i, "\n".join(f"the lantern of the {w} hill {i} keeps" for w in ("old", "low", "far", "red", "dim", "wet")), "verse") for i in range(12)]
    prose = [(100 + i, f"{PROSE.format(i).strip()}\n{PROSE.format(i + 50).strip()}\nThe reader of {chr(97 + i) * (3 + 5 * i)} and", "prose") for i in range(12)]
    desk = [(200 + i, f"{PROSE.format(i).strip()}\n~{i % 3} desk nine{i}\n{PROSE.format(i + 70).strip()}\n~4 from the night{i} desk", "desk") for i in range(12)]
    got = {r.doc_id: r.evidence for r in truncated(table(spark, verse + prose + desk)).collect()}
    assert {k for k, e in got.items() if e} == {i for i, _, _ in prose}
    assert set(got.values()) == {None, "open line"}


def test_long_last_line_that_stands_elsewhere_is_whole(spark):
    line = "No part of this text may leave the hall of the lantern without a word from the keeper " * 30
    data = [(1, "One sentence.\n" + line, "a"), (2, f"Another.\n{line}\nAnd an end.", "b"), (3, f"A third.\n{line}\nAnd one more.", "c"), (4, "One sentence.\n" + line[:-7], "d")]
    assert {r.doc_id for r in truncated(table(spark, data)).filter("cut").collect()} == {4}


def test_evidence(spark):
    data, want = rows()
    got = {r.doc_id: r.evidence for r in truncated(table(spark, data)).filter("cut").collect()}
    assert set(got) == want
    assert {e for k, e in got.items() if k < 40} == {"spike"} and got[103] == got[115] == "mark" and got[101] == got[121] == "open line"
    for r in truncation_rates(table(spark, data)).collect():
        assert r.n_spike + r.n_mark + r.n_open == r.n_cut
