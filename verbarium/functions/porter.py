"""Porter's stemming algorithm (1980), with its author's later changes.

A word is described by a string of classes, ``c`` for consonants and ``v`` for vowels; the
measure of a stem is the number of its ``vc`` changes. Each step is a table of endings,
tried longest first; the first that fits decides, whether its condition holds or not.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ending and replacement, where the measure before the ending is above 0.
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
QUALITY = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Endings that go where the measure before them is above 1.
LATINATE = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_CHANGE = re.compile("v+c+")
_by_length = {id(t): sorted(t, key=len, reverse=True) for t in (DERIVED, QUALITY, LATINATE)}


def _classes(word: str) -> str:
    out: list[str] = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(_CHANGE.findall(_classes(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _classes(word)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _classes(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _classes(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _ending(word: str, table) -> str | None:
    return next((e for e in _by_length[id(table)] if word.endswith(e)), None)


def _plurals_and_participles(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + "i"
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or not _has_vowel(w[:-cut]):
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _doubled(w):
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if _measure(w) == 1 and _short(w) else w


def _replace(w: str, table: dict[str, str]) -> str:
    e = _ending(w, table)
    return w[: -len(e)] + table[e] if e and _measure(w[: -len(e)]) > 0 else w


def _drop(w: str) -> str:
    e = _ending(w, LATINATE)
    if not e or _measure(w[: -len(e)]) <= 1:
        return w
    return w if e == "ion" and w[-4] not in "st" else w[: -len(e)]


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _plurals_and_participles(word)
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    if len(w) > 1:
        w = _replace(w, DERIVED)
    w = _replace(w, QUALITY)
    if len(w) > 1:
        w = _drop(w)
    m = _measure(w)
    if w.endswith("e") and (m > 1 or (m == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stems(words: pa.Array) -> pa.Array:
    """The stem of each word; every distinct word of the batch is looked at once."""
    coded = pc.dictionary_encode(words)
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_tokens(tokens: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(tokens), _stems(tokens.flatten()))


def _offsets(lists: pa.Array) -> pa.Array:
    """The offsets of the flattened lists, null for a null list."""
    sizes = lists.value_lengths()
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
    null = np.append(sizes.is_null().to_numpy(zero_copy_only=False), False)
    return pa.array(np.concatenate([np.zeros(1, dtype=np.int32), ends]), pa.int32(), mask=null)


@F.arrow_udf(T.StringType())
def _stem_words(words: pa.Array) -> pa.Array:
    return _stems(words)


def stem_tokens(tokens: Column) -> Column:
    """Each token's stem, by the distinct words of each Arrow batch; every worker keeps the stems of the words it met last."""
    return _stem_tokens(tokens)


def stem_word(word: Column) -> Column:
    return _stem_words(word)
