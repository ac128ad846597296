"""Continuous ingest: each micro-batch becomes segments of a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbarium.functions.text import Analyzer, analyzer
from verbarium.operators.index import FLUSH_DOCS, TextIndex, _numbered, build_postings, write_batch
from verbarium.session import _hadoop_path, has_path

#: Largest segment number.
LAST_SEGMENT = (1 << 31) - 1


def _first_segment(spark: SparkSession, path: str, batch_id: int, count: int) -> int:
    """The first of ``count`` segment numbers for a batch, kept in the log of the index.

    The log has an empty folder ``batches/<batch>_<first>_<count>`` for each batch, made
    before the batch is written; a batch that runs again finds its own.
    """
    log, fs = _hadoop_path(spark, f"{path}/batches")
    taken = [tuple(map(int, x.getPath().getName().split("_"))) for x in fs.listStatus(log)] if fs.exists(log) else []
    for batch, first, n in taken:
        if batch == batch_id:
            if n != count:
                raise ValueError(f"batch {batch_id} had {n} segments and has {count} when run again")
            return first
    if taken:
        first = max(f + n for _, f, n in taken)
    elif has_path(spark, f"{path}/segments"):  # an index without a log
        last = spark.read.parquet(f"{path}/segments").agg(F.max("seg_id")).first()[0]
        first = 0 if last is None else last + 1
    else:
        first = 0
    if first + count - 1 > LAST_SEGMENT:
        raise OverflowError(f"batch {batch_id}: no segment numbers are left from {first} on")
    fs.mkdirs(_hadoop_path(spark, f"{path}/batches/{batch_id}_{first}_{count}")[0])
    return first


def ingest(docs: DataFrame, path: str, checkpoint: str, analyze: Analyzer | None = None, per_segment: int = FLUSH_DOCS, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of ``doc_id, text`` to the index at ``path``.

    A batch of any size gets the segment numbers after those of the batches before it. They
    are logged, and its folder is written anew if the batch runs again, so a restart neither
    loses nor repeats documents. Documents are searchable once their batch is written.
    """
    analyze = analyze or analyzer()

    def write(batch: DataFrame, batch_id: int) -> None:
        count = -(-batch.filter(F.col("text").isNotNull()).count() // per_segment)
        if not count:
            return
        first = _first_segment(batch.sparkSession, path, batch_id, count)
        documents, catalogue = _numbered(batch, "doc_id", "text", per_segment, first)
        write_batch(path, first, documents, build_postings(documents, analyze), catalogue)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def open_stream_index(spark: SparkSession, path: str, analyze: Analyzer | None = None) -> TextIndex:
    """The index as it stands, with the deletions that were stored there."""
    return TextIndex.open(spark, path, analyze)
