"""Lines that one source repeats over and over (problem 1).

First pass: every task keeps a Misra-Gries summary of line forms per source and passes on
its counters. The counters of all tasks add up to lower bounds, and the amounts that the
tasks took off add up to the largest possible error, so every line above the threshold is
among the candidates. Second pass: exact counts of the candidates. A source whose error
reaches its threshold is counted exactly in full instead, so nothing is lost whatever the
data. Removal: confirmed lines as one set per source, broadcast if the sets are small and
otherwise joined line by line.

Line forms are 64-bit hashes. Only a line that meets one of its source's candidates could be
taken for it, which of a billion lines and a thousand candidates one does with a probability
below 1e-7.

Defined cases: null texts have no lines but count as documents of their source; a null
source is a source of its own; a line repeated within a document counts once; repeated rows
are documents of their own; lines without letters are never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.words import line_form
from verbarium.session import materialize

#: Counters per source and task.
COUNTERS = 2048
#: Counters of all sources that a task keeps before it passes them on.
MAX_STATE = 1_000_000
#: Confirmed lines up to which they are broadcast, about 20 MB.
BROADCAST_LINES = 500_000


def _forms(text: Column) -> Column:
    """The form of each line; null for a line without letters."""
    return F.transform(F.transform(F.split(text, "\n", -1), line_form), lambda x: F.when(x != "", F.xxhash64(x)))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, forms array<bigint>`` of each row, as a table in the shared folder."""
    return materialize(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), _forms(F.col(text)).alias("forms")), "lines"
    )


class Summaries:
    """Misra-Gries summaries of many sources, updated by arrays."""

    def __init__(self, counters: int):
        self.counters = counters
        self.state: dict = {}
        self.size = 0

    def add(self, source, forms: np.ndarray) -> None:
        new, counts = np.unique(forms, return_counts=True)
        old = self.state.get(source)
        error = 0
        if old is not None:
            keys, sums, error = old
            self.size -= len(keys)
            merged, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(merged), dtype=np.int64)
            np.add.at(total, where, np.concatenate([sums, counts]))
            new, counts = merged, total
        if len(new) > self.counters:
            # Take the largest left-out count off all: the merging step of mergeable summaries.
            off = int(np.partition(counts, len(counts) - self.counters - 1)[len(counts) - self.counters - 1])
            keep = counts > off
            new, counts, error = new[keep], counts[keep] - off, error + off
        self.state[source] = (new, counts, error)
        self.size += len(new)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for source, (keys, counts, error) in self.state.items():
            n = len(keys) + 1  # the last row has the error
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([source] * n, pa.string()),
                    pa.array([*keys.tolist(), None], pa.int64()),
                    pa.array([*counts.tolist(), error], pa.int64()),
                ],
                names=["source", "form", "n"],
            )
        self.state, self.size = {}, 0


def _summaries(lines: DataFrame, counters: int) -> DataFrame:
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summaries(counters)
        for batch in batches:
            names, index = np.unique(np.array([x or "" for x in batch.column("source").to_pylist()], dtype=object), return_inverse=True)
            null = batch.column("source").is_null().to_numpy(zero_copy_only=False)
            forms = batch.column("forms")
            sizes = forms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = forms.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.where(null, len(names), index), sizes)
            for i in np.unique(owner):
                s.add(None if i == len(names) else names[i], flat[owner == i])
            if s.size > MAX_STATE:
                yield from s.rows()
        yield from s.rows()

    once = F.array_distinct(F.filter("forms", lambda x: x.isNotNull()))
    return lines.select("source", once.alias("forms")).mapInArrow(summarize, "source string, form bigint, n bigint")


def _by_source(left: DataFrame, right: DataFrame, also: list[str], how: str, broadcast: bool) -> DataFrame:
    right = right.select([F.col(c).alias(f"_{c}") for c in right.columns])
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(F.broadcast(right) if broadcast else right, on, how)


def repeated_lines(lines: DataFrame, share: float = 0.1, least: int = 3, counters: int = COUNTERS) -> DataFrame:
    """``source, form, n_docs`` of the lines in at least ``share`` and ``least`` documents of their source, as a table."""
    sizes = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    limits = sizes.select("source", F.greatest(F.ceil(F.col("n") * share - 1e-9), F.lit(least)).alias("limit"))
    sums = _summaries(lines, counters).groupBy("source", "form").agg(F.sum("n").alias("n"))
    sums = materialize(_by_source(sums, limits, [], "inner", False).select("source", "form", "n", F.col("_limit").alias("limit")), "summaries")
    errors = sums.filter("form is null").select("source", F.col("n").alias("error"), F.col("limit").alias("least"))
    sure = errors.filter("error < least").select("source", "error")
    full = errors.filter("error >= least").select("source")
    candidates = materialize(
        _by_source(sums.filter("form is not null"), sure, [], "inner", False)
        .filter("n + _error >= limit")
        .select("source", "form"),
        "candidates",
    )
    small = candidates.count() <= BROADCAST_LINES
    each = lines.select("source", F.explode(F.array_distinct(F.filter("forms", lambda x: x.isNotNull()))).alias("form"))
    second = _by_source(each, candidates, ["form"], "left_semi", small).unionByName(_by_source(each, full, [], "left_semi", False))
    counts = second.groupBy("source", "form").agg(F.count(F.lit(1)).alias("n_docs"))
    return materialize(
        _by_source(counts, limits, [], "inner", False).filter("n_docs >= _limit").select("source", "form", "n_docs"), "repeated"
    )


def repeated_line_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``key, line_no`` of the repeated lines, numbered from 1."""
    lines = line_table(docs, key, text, source)
    found = repeated_lines(lines, **options)
    small = found.count() <= BROADCAST_LINES
    each = lines.select("key", "source", F.posexplode("forms").alias("pos", "form")).filter("form is not null")
    return _by_source(each, found, ["form"], "left_semi", small).select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("line_no")
    )


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``key, text, n_removed`` of each row; a null text stays null with 0 removed."""
    lines = line_table(docs, key, text, source)
    found = repeated_lines(lines, **options)
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    if found.count() <= BROADCAST_LINES:
        sets = found.groupBy("source").agg(F.collect_list("form").alias("set"))
        joined = _by_source(base, sets, [], "left", True).withColumn("_set", F.coalesce("_set", F.array().cast("array<bigint>")))
        split = F.split(F.col("text"), "\n", -1)
        kept = F.filter(split, lambda x: ~F.array_contains("_set", F.xxhash64(line_form(x))))  # no set has the hash of an empty form
        return joined.withColumn("kept", kept).select(
            F.col("key").alias(key),
            F.array_join("kept", "\n").alias(text),
            F.coalesce(F.size(split) - F.size("kept"), F.lit(0)).alias("n_removed"),
        )
    # Too many lines for a broadcast: line by line, brought together per row again.
    rows = materialize(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    each = rows.select("row", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn(
        "form", F.xxhash64(line_form(F.col("line")))
    )
    marked = _by_source(each, found.withColumn("hit", F.lit(1)), ["form"], "left", False)
    one = marked.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("kept"),
        F.sum(F.coalesce("_hit", F.lit(0))).cast("int").alias("n"),
    )
    return rows.join(one, "row", "left").select(
        F.col("key").alias(key), F.when(F.col("text").isNotNull(), F.coalesce("kept", F.lit(""))).alias(text), F.coalesce("n", F.lit(0)).alias("n_removed")
    )
