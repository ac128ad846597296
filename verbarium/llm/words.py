"""Words, lines and their normal forms, as the corpus problems define them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of these in the lower-cased text.
WORD = re.compile("[a-z0-9]+")
#: Distinct words that a task keeps before it passes its counts on.
FLUSH_TERMS = 400_000

# The English names of the months.
MONTHS = "january february march april may june july august september october november december".split()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def line_form(line: Column) -> Column:
    """What is left of a line without case, space, invisible characters, punctuation, symbols, numbers and months."""
    months = "|".join(MONTHS)
    return F.regexp_replace(F.lower(line), rf"(?<!\p{{L}})(?:{months})(?!\p{{L}})|[^\p{{L}}\p{{M}}]+|[︀-️]", "")


_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: Characters of the texts whose words are looked up at once.
BATCH_CHARS = 4 << 20


class WordTable:
    """The words of some texts, by number: each word's number, the words, and the bounds of each text's own."""

    __slots__ = ("codes", "terms", "bounds")

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        inside = _WORD_BYTES[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        # The words' bytes close up to an Arrow array, which numbers them.
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        coded = found.dictionary_encode()
        self.codes, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.bounds = np.searchsorted(starts, begin)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text, word, n``: the distinct words of each text and how often they stand there, by text."""
        k = max(1, len(self.terms))
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        both, n = np.unique(owner * k + self.codes, return_counts=True)
        return both // k, both % k, n


def text_slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The rows and texts of a column without nulls, about ``BATCH_CHARS`` characters at a time."""
    limit, rows, texts, held = limit or BATCH_CHARS, [], [], 0
    for i, v in enumerate(column):
        if v.is_valid:
            rows.append(i), texts.append(v.as_py())
            held += len(texts[-1])
            if held >= limit:
                yield np.array(rows), texts
                rows, texts, held = [], [], 0
    if texts:
        yield np.array(rows), texts


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes, so that results stay small."""
    sizes = batch.column(column)
    start, total = 0, 0
    for i in range(batch.num_rows):
        v = sizes[i]
        total += v.as_buffer().size if v.is_valid else 0
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def partial_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, tf, df`` of each task's share of the texts; the row with a null term counts non-null texts.

    Sums by term give the counts of the whole table. A task keeps at most about
    ``FLUSH_TERMS`` distinct words, however large its share is.
    """

    def out(counts: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["term", "tf", "df"])
        for b in counts.to_batches(100_000):
            yield pa.RecordBatch.from_arrays([b.column("term").cast(pa.string()), b.column("tf"), b.column("df")], names=["term", "tf", "df"])

    def summed(tables: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(tables).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
        return pa.table({"term": both.column("term"), "tf": both.column("tf_sum"), "df": both.column("df_sum")})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.table({"term": pa.array([], pa.large_string()), "tf": pa.array([], pa.int64()), "df": pa.array([], pa.int64())})
        kept, waiting, held, n = empty, [], 0, 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                n += len(texts)
                w = WordTable(texts)
                tf = np.bincount(w.codes, minlength=len(w.terms))
                df = np.bincount(w.pairs()[1], minlength=len(w.terms))
                waiting.append(pa.table({"term": w.terms, "tf": tf.astype(np.int64), "df": df.astype(np.int64)}))
                held += len(w.terms)
                if held > FLUSH_TERMS:
                    kept, waiting, held = summed([kept, *waiting]), [], 0
                    if kept.num_rows > FLUSH_TERMS:
                        yield from out(kept, n)
                        kept, n = empty, 0
        yield from out(summed([kept, *waiting]), n)

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "term string, tf bigint, df bigint")
