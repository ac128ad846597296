"""How well a word marks its document among all (problem 5).

The score is a damped term frequency times the logarithm of the inverse document frequency.
Document frequencies come from distributed distinct word-document counts. The ``HEAD`` words
in the most documents, a table of fixed size, are broadcast and scored where the texts are;
all other words, each in few documents, are joined with their counts by word. So no join
key is hot, and only the long tail of rare words is shuffled.

Defined cases: null texts have no rows and don't count for N; texts with fewer than
``min_words`` distinct words have no rows; ties go to the smaller word; repeated rows of one
key are scored each, and give each their rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbarium.llm.words import WordTable, partial_counts, text_slices
from verbarium.session import materialize

#: Words whose counts are broadcast; about 2 MB.
HEAD = 20_000


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df``; the row with a null term has the number of non-null texts."""
    return partial_counts(docs, text).groupBy("term").agg(F.sum("df").alias("df"))


def distinctive_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    best: int = 3,
    min_words: int = 20,
    min_df: int = 2,
    smooth: float = 0.0,
    normalize: bool = False,
    head_size: int = HEAD,
    digits: int = 6,
) -> DataFrame:
    """``key, term, score`` of the ``best`` words of each text.

    score = (1 + log10 tf) * log10((N + smooth) / (df + smooth)), rounded; with ``normalize``
    divided by the square root of the text's number of words before rounding.
    """
    spark = docs.sparkSession
    counts = materialize(document_frequencies(docs, text).filter(f"term is null or df >= {min_df}"), "df")
    n_docs = counts.filter("term is null").agg(F.sum("df")).first()[0] or 0
    # The head is cut at a step of the counts' logarithm, found from a histogram of some hundred rows.
    step = F.floor(F.log2("df") * 8)
    listed = counts.filter("term is not null")
    steps = {r.step: r.n for r in listed.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, size = max(steps, default=0) + 1, 0
    for k in sorted(steps, reverse=True):
        size += steps[k]
        if size > head_size:
            break
        first = k
    head = {r.term: r.df for r in listed.filter(step >= first).collect()}  # at most head_size rows
    shared = spark.sparkContext.broadcast(head)
    kind = docs.schema[key].dataType

    def idf(df: int) -> float:
        return math.log10((n_docs + smooth) / (df + smooth))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_of = shared.value
        listed = pa.array(list(df_of), pa.large_string())
        weights = np.array([*map(idf, df_of.values()), math.nan])  # the last one for words that aren't listed
        rarest = idf(min_df) if n_docs else 0.0
        for batch in batches:
            for rows, texts in text_slices(batch.column("text")):
                w = WordTable(texts)
                owner, word, tf = w.pairs()
                sizes = np.bincount(owner, minlength=len(texts))
                long = sizes[owner] >= min_words
                owner, word, tf = owner[long], word[long], tf[long]
                at = pc.index_in(w.terms, value_set=listed).fill_null(len(listed)).to_numpy() if len(w.terms) else np.zeros(0, dtype=np.int64)
                weight = weights[at][word]
                damped = np.array([0.0, 1.0, *(1 + math.log10(c) for c in range(2, int(tf.max()) + 1))] if len(tf) else [0.0])[tf]
                norm = np.sqrt(np.diff(w.bounds))[owner] if normalize else np.ones(len(owner))
                share, score = damped / norm, damped * weight / norm
                # By text and falling score; those within the rounding of the best are rounded and ordered exactly.
                head = np.flatnonzero(~np.isnan(score))
                head = head[np.lexsort((-score[head], owner[head]))]
                first = np.searchsorted(owner[head], np.arange(len(texts)))
                count = np.diff(np.append(first, len(head)))
                least = np.full(len(texts), -math.inf)
                enough = count >= best
                least[enough] = score[head][first[enough] + best - 1]
                near = head[score[head] >= least[owner[head]] - 2 * 10.0**-digits]
                terms = w.terms.take(pa.array(word[near])).to_pylist()
                found: dict[int, list[tuple[float, str]]] = {}
                for i, s, t in zip(owner[near].tolist(), score[near].tolist(), terms):
                    found.setdefault(i, []).append((-round(s, digits), t))
                out_row, out_term, out_score = [], [], []
                floor = np.full(len(texts), -math.inf)
                for i, scored in found.items():
                    scored.sort()
                    if len(scored) >= best:
                        floor[i] = -scored[best - 1][0]
                    for s, t in scored[:best]:
                        out_row.append(i), out_term.append(t), out_score.append(-s)
                tail = np.flatnonzero(np.isnan(score))
                tail = tail[share[tail] * rarest + 10.0**-digits >= floor[owner[tail]]]  # only those that could still win go on
                every = pa.array(rows[np.concatenate([np.array(out_row, dtype=np.int64), owner[tail]])], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(every),
                        batch.column("key").take(every),
                        pa.concat_arrays([pa.array(out_term, pa.string()), w.terms.take(pa.array(word[tail])).cast(pa.string())]),
                        pa.concat_arrays([pa.array(out_score, pa.float64()), pa.nulls(len(tail), pa.float64())]),
                        pa.concat_arrays([pa.nulls(len(out_row), pa.float64()), pa.array(share[tail], pa.float64())]),
                    ],
                    names=["row", "key", "term", "score", "share"],
                )

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    local = base.mapInArrow(score, f"row bigint, key {kind.simpleString()}, term string, score double, share double")
    local = materialize(local, "scored")
    rest = listed.filter(step < first).hint("merge")  # it grows with the corpus, so it is never broadcast
    tail = (
        local.filter("share is not null")
        .join(rest, "term")
        .withColumn("score", F.round(F.col("share") * F.log10((F.lit(n_docs) + smooth) / (F.col("df") + smooth)), digits))
        .select("row", "key", "term", "score")
    )
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "term"))
    return (
        local.filter("share is null")
        .select("row", "key", "term", "score")
        .unionByName(tail)
        .withColumn("place", place)
        .filter(F.col("place") <= best)
        .select(F.col("key").alias(key), "term", "score")
    )
