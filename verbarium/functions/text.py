"""Tokenizers and analyzers as expressions on columns.

An analyzer is a function from a text column to an array of tokens. The tokenizers are
built-in expressions; only stemming and word segmentation run in Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbarium.functions.stopwords import STOP_WORDS

Analyzer = Callable[[Column], Column]

#: What Java's ``\s`` matches, also at the ends of a text.
_SPACE = r"[ \t\n\x0B\f\r]"


def tokenize_naive(text: Column) -> Column:
    """Lower-cased pieces between white space; a leading empty piece stays, trailing ones go.

    An empty text gives one empty token, a text of only white space none, null gives null.
    """
    lowered = F.lower(text)
    pieces = F.split(F.regexp_replace(lowered, f"{_SPACE}+$", ""), f"{_SPACE}+")
    return F.when(F.length(text) == 0, F.array(F.lit(""))).when(lowered.rlike(f"^{_SPACE}+$"), F.array().cast("array<string>")).otherwise(pieces)


def tokenize_punctuation(text: Column, stop_words: list[str] | None = STOP_WORDS) -> Column:
    """Lower-cased pieces between white space and the marks ``, . ; ? !``, without stop words and empty pieces.

    Other punctuation belongs to its token. Null gives null.
    """
    pieces = F.split(F.lower(F.translate(text, ",.;?!", "     ")), f"{_SPACE}+")
    pieces = F.filter(pieces, lambda x: x != "")
    return without_stop_words(pieces, stop_words) if stop_words else pieces


def without_stop_words(tokens: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(stop_words))


def analyzer(tokenizer: Analyzer = tokenize_punctuation, stemmer: Callable[[Column], Column] | None = None) -> Analyzer:
    """A tokenizer followed by a stemmer of token arrays; without one, tokens stay as they are."""
    return lambda text: stemmer(tokenizer(text)) if stemmer else tokenizer(text)
