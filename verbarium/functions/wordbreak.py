"""Breaking text without spaces into dictionary words.

The most probable segmentation is found by dynamic programming over sums of logarithms, in
time linear in the text for a dictionary with bounded word length.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium.functions.stopwords import STOP_WORDS

#: Words up to which a dictionary may be broadcast.
MAX_WORDS = 2_000_000
_STOP = frozenset(STOP_WORDS)


class UnbreakableError(ValueError):
    """The text is no sequence of dictionary words."""


class Dictionary:
    """Words with the logarithms of their probabilities."""

    def __init__(self, freq: dict[str, float]):
        total = sum(freq.values())
        self._set({w: math.log(f / total) for w, f in freq.items() if f > 0})

    def _set(self, log_p: dict[str, float]) -> None:
        self.log_p = log_p
        self.longest = max(map(len, log_p), default=0)

    @classmethod
    def of(cls, log_p: dict[str, float]) -> Dictionary:
        """From logarithms of probabilities."""
        d = cls.__new__(cls)
        d._set(log_p)
        return d

    def segment(self, text: str, tie: str = "first") -> list[str]:
        """The best segmentation; of equal ones that with the shorter (``last``: longer) words first."""
        n = len(text)
        best: list[float | None] = [None] * n + [0.0]
        step = [0] * n
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = self.log_p.get(text[i:j])
                if p is None or best[j] is None:
                    continue
                p += best[j]
                gain = None if best[i] is None else p - best[i]
                if gain is None or gain > 1e-12 or (tie == "last" and gain > -1e-12):
                    best[i], step[i] = p, j
        if n and best[0] is None:
            raise UnbreakableError("there is no way to break the text")
        words, i = [], 0
        while i < n:
            words.append(text[i : step[i]])
            i = step[i]
        return words

    def segment_forward(self, text: str) -> list[str]:
        """As ``segment``, but of equal ones that with the longer last word; an unbreakable text is one word."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        back = [0] * (n + 1)
        for i in range(n):
            if best[i] is None:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = self.log_p.get(text[i:j])
                if p is not None and (best[j] is None or best[i] + p > best[j] + 1e-12):
                    best[j], back[j] = best[i] + p, i
        if best[n] is None:
            return [text]
        words, j = [], n
        while j > 0:
            words.append(text[back[j] : j])
            j = back[j]
        return words[::-1]


def break_words(d: Dictionary, text: str, tie: str = "first", on_empty: str = "empty") -> list[str]:
    """English: lower-cased, broken, and then without stop words."""
    if not text:
        if on_empty == "error":
            raise UnbreakableError("the text is empty")
        return []
    return [w for w in d.segment(text.lower(), tie) if w not in _STOP]


def break_cjk(d: Dictionary, text: str) -> list[str]:
    """Chinese or Japanese: the case stays, and an unbreakable text is one word."""
    if not text:
        raise UnbreakableError("the text is empty")
    return [w for w in d.segment_forward(text) if w not in _STOP]


def clean_dictionary(lines: DataFrame, lang: str, lower: bool = True) -> DataFrame:
    """``word, freq`` of one language: without byte-order marks and outer space; repeated words are summed.

    Rows without a word or with a frequency that is null or not above zero are left out.
    """
    word = F.regexp_replace("word", "^[\\s\\h\\ufeff\\u200b]+|[\\s\\h\\ufeff\\u200b]+$", "")
    return (
        lines.filter((F.col("lang") == lang) & (F.col("freq") > 0) & ~F.isnan("freq"))
        .select((F.lower(word) if lower else word).alias("word"), "freq")
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.sum("freq").alias("freq"))
    )


def load_dictionary(words: DataFrame) -> Dictionary:
    """The dictionary on the driver; a table above ``MAX_WORDS`` is refused and left to ``word_break_joined``."""
    rows = words.limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
    return Dictionary({r.word: r.freq for r in sorted(rows)})


def word_break(
    spark: SparkSession, text: Column, dictionary: Dictionary, cjk: bool = False, tie: str = "first", on_empty: str = "empty", on_unbreakable: str = "error"
) -> Column:
    """The words of each text; with ``on_unbreakable='null'`` a text that can't be broken gives null."""
    shared = spark.sparkContext.broadcast(dictionary)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _broken(shared.value, t, cjk, tie, on_empty, on_unbreakable))

    return run(text)


def _broken(d: Dictionary, text: str | None, cjk: bool, tie: str, on_empty: str, on_unbreakable: str) -> list[str] | None:
    if text is None:
        return None
    try:
        return break_cjk(d, text) if cjk else break_words(d, text, tie, on_empty)
    except UnbreakableError:
        if on_unbreakable == "error":
            raise
        return None


def word_break_joined(
    texts: DataFrame, words: DataFrame, text: str = "text", cjk: bool = False, tie: str = "first", on_empty: str = "empty", on_unbreakable: str = "error"
) -> DataFrame:
    """``text, words`` of each distinct text, for a dictionary of any size.

    Nothing is broadcast: the pieces of the texts, up to the length of the longest word, are
    joined with the words, and each text is broken by the words found in it.
    """
    total, longest = words.agg(F.sum("freq"), F.max(F.length("word"))).first()
    listed = words.filter("freq > 0").select("word", F.log(F.col("freq") / F.lit(total or 1.0)).alias("log_p"))
    once = texts.select(F.col(text).alias("text")).filter("text is not null").distinct()
    whole = F.col("text") if cjk else F.lower("text")
    at = once.select("text", whole.alias("whole"), F.explode(F.sequence(F.lit(1), F.length(whole))).alias("i")).filter("i <= length(whole)")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest or 1), F.length("whole") - F.col("i") + 1)))
    pieces = at.select("text", "whole", "i", lengths.alias("n")).select("text", F.expr("substring(whole, i, n)").alias("word")).distinct()
    known = pieces.join(listed, "word").groupBy("text").agg(F.collect_list(F.struct("word", "log_p")).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([
            _broken(Dictionary.of({x["word"]: x["log_p"] for x in (k if k is not None else ())}), t, cjk, tie, on_empty, on_unbreakable) for t, k in zip(texts, known)
        ])

    return once.join(known, "text", "left").select(F.col("text").alias(text), run("text", "known").alias("words"))
