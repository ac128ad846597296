import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.functions.wordbreak import Dictionary, UnbreakableError, break_cjk, break_words, clean_dictionary, load_dictionary, word_break, word_break_joined

D = Dictionary({"the": 80.0, "mill": 6.0, "by": 70.0, "stream": 9.0, "sea": 4.0, "seas": 3.0, "hell": 1.0, "shell": 5.0, "and": 60.0, "we": 20.0, "are": 25.0})
ZH = Dictionary({"看": 5.0, "图书": 8.0, "书馆": 2.0, "图书馆": 6.0, "的": 9.0, "灯": 3.0})


def test_english():
    assert break_words(D, "TheMillByTheStream") == ["mill", "stream"]
    assert break_words(D, "seashell") == ["sea", "shell"]  # and not "seas hell", which is rarer
    assert break_words(D, "weareandwe") == []
    assert break_words(D, "") == []


@pytest.mark.parametrize("text", ["mill7", "sea-shell", "the mill", "mill."])
def test_unbreakable(text):
    with pytest.raises(UnbreakableError):
        break_words(D, text)
    with pytest.raises(UnbreakableError):
        break_words(D, "", on_empty="error")


def test_chinese():
    assert break_cjk(ZH, "看图书馆的灯") == ["看", "图书馆", "的", "灯"]
    assert break_cjk(ZH, "看月亮") == ["看月亮"]
    with pytest.raises(UnbreakableError):
        break_cjk(ZH, "")


def test_ties():
    d = Dictionary({"a": 1.0, "ab": 1.0, "bc": 1.0, "c": 1.0})
    assert d.segment("abc", "first") == ["a", "bc"]
    assert d.segment("abc", "last") == ["ab", "c"]


def brute(d, text):
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        words, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(text[start:i])
                start = i
        words.append(text[start:])
        if all(w in d.log_p for w in words):
            p = sum(d.log_p[w] for w in words)
            if best is None or p > best:
                best = p
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=10))
def test_best_segmentation(text):
    d = Dictionary({"a": 1.0, "ab": 5.0, "ba": 2.0, "abb": 3.0, "bb": 1.0})
    best = brute(d, text)
    if best is None:
        with pytest.raises(UnbreakableError):
            d.segment(text)
    else:
        assert math.isclose(sum(d.log_p[w] for w in d.segment(text)), best)
        assert "".join(d.segment(text)) == text


def test_long_text_does_not_underflow():
    assert len(D.segment("mill" * 20_000)) == 20_000


def test_dictionary_table_and_column(spark):
    lines = spark.createDataFrame(
        [("﻿Cat", 2.0, "en"), ("cat ", 3.0, "en"), ("dog", None, "en"), ("cow", 0.0, "en"), ("cow", -1.0, "en"), (None, 3.0, "en"), ("dog", 5.0, "en"), ("猫", 1.0, "zh")],
        "word string, freq double, lang string",
    )
    words = clean_dictionary(lines, "en")
    assert {tuple(r) for r in words.collect()} == {("cat", 5.0), ("dog", 5.0)}
    df = spark.createDataFrame([("catDog",), ("cow",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(word_break(spark, F.col("t"), load_dictionary(words), on_unbreakable="null")).collect()]
    assert got == [["cat", "dog"], None, [], None]


def test_joined_dictionary_breaks_alike(spark):
    rows = [("the", 80.0), ("mill", 6.0), ("by", 70.0), ("stream", 9.0), ("sea", 4.0), ("seas", 3.0), ("hell", 1.0), ("shell", 5.0)]
    words = spark.createDataFrame(rows, "word string, freq double")
    texts = ["TheMillByTheStream", "seashell", "seashells", "", None, "mill", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.words for r in word_break_joined(df.union(df), words, "t", on_unbreakable="null").collect()}
    want = {r.t: r.w for r in df.filter("t is not null").select("t", word_break(spark, F.col("t"), load_dictionary(words), on_unbreakable="null").alias("w")).collect()}
    assert got == want and got["seashell"] == ["sea", "shell"]
    assert [r.words for r in word_break_joined(spark.createDataFrame([("millx",)], "t string"), words, "t", cjk=True).collect()] == [["millx"]]
