"""Occurrences and documents of every distinct word (problem 3).

Recursive radix spilling: each task counts its own texts and passes on its distinct words,
which are partitioned by bits of their hash to the shared disk. Partitions above
``MAX_PART_BYTES``, as they are in memory, are split by further bits, as often as needed.
Each partition is then aggregated by DuckDB in one task, within a fixed memory. Where the
shared folder is a file system of the machines, DuckDB spills to it; where it is not, or if
memory is short all the same, the task reads its partition again in two, four, ... parts by
the terms' hashes, so the result never depends on where DuckDB may spill. A word's partial
rows are at most one per task and flush, so skewed words cost nothing.

Defined cases: null texts count for nothing; empty texts count as documents; words are
counted whatever their length; repeated rows are documents of their own; an empty table
gives only the dictionary's words, all rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbarium.llm.words import partial_counts
from verbarium.session import _hadoop_path, drop_path, materialize, scratch_path

#: A partition whose terms and counts have more bytes than this, uncompressed, is split further.
MAX_PART_BYTES = 64 << 20
#: Bytes of a row besides its term.
ROW_BYTES = 24
#: Least bits of the first split, bits of each further one, and of all together.
FIRST_BITS, NEXT_BITS, ALL_BITS = 4, 3, 60
DUCKDB_MEMORY = "400MB"
#: Parts in which a task may read its partition at most; a part then has words of one hash.
MAX_PASSES = 1 << 16


def _spill(rows: DataFrame, bits: int, partitions: int) -> str:
    """The rows in folders by the first ``bits`` of their terms' hashes, on the shared disk."""
    path = scratch_path(rows.sparkSession, "radix")
    (
        rows.withColumn("part", F.shiftrightunsigned(F.xxhash64("term"), 64 - bits))
        .repartition(partitions, "part")
        .write.partitionBy("part")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def _parts(spark: SparkSession, schema, path: str) -> list[tuple[str, int]]:
    """The folders below ``path``, as many as there are hash values, with the bytes of their rows; rows of one term need no room."""
    p, fs = _hadoop_path(spark, path)
    folders = {int(s.getPath().getName().split("=")[1]): s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()}
    size = F.sum(F.coalesce(F.octet_length("term"), F.lit(0)).cast("long") + ROW_BYTES).alias("size")
    sizes = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.LongType())])).parquet(path).groupBy("part").agg(size, (F.min("term") < F.max("term")).alias("several")) if folders else None
    return [(folders[r.part], r.size if r.several else 0) for r in sizes.collect()] if folders else []


def aggregate_file(rows, spill: str | None, memory: str = DUCKDB_MEMORY) -> Iterator[pa.RecordBatch]:
    """Sums by term of the dataset ``rows``, in as many passes over parts of its terms as the memory needs."""
    import duckdb

    parts = [(0, 1)]  # the terms whose hash is k modulo n
    while parts:
        k, n = parts.pop()
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False})
        con.execute(f"SET temp_directory = '{spill or ''}'")  # never a folder of this machine alone
        try:
            con.register("part", rows.scanner(columns=["term", "tf", "df"], batch_size=8192).to_reader())
            mine = f"WHERE hash(coalesce(term, '')) % {n} = {k}" if n > 1 else ""
            result = con.sql(f"SELECT term, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df FROM part {mine} GROUP BY term").to_arrow_table()
        except duckdb.OutOfMemoryException:
            if n >= MAX_PASSES:
                raise
            parts += [(k + n, 2 * n), (k, 2 * n)]
            continue
        finally:
            con.close()
        yield from result.to_batches(50_000)


def radix_aggregate(partial: DataFrame, max_part_bytes: int = MAX_PART_BYTES, first_bits: int | None = None) -> DataFrame:
    """Sums of ``tf`` and ``df`` by ``term``, as a table in the shared folder."""
    spark = partial.sparkSession
    bits = first_bits or max(FIRST_BITS, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    roots = [_spill(partial, bits, 1 << bits)]
    ready: list[str] = []
    while True:
        parts = _parts(spark, partial.schema, roots[-1])
        large = [p for p, n in parts if n > max_part_bytes and bits + NEXT_BITS <= ALL_BITS]
        ready += [p for p, n in parts if n <= max_part_bytes or not large]
        if not large:
            break
        # All oversized partitions of a level are split in one job.
        bits += NEXT_BITS
        roots.append(_spill(spark.read.schema(partial.schema).parquet(*large), bits, len(large) << NEXT_BITS))
    spill_url = scratch_path(spark, "duckdb")

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import shutil
        import uuid

        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                folder = None
                if urlparse(spill_url).scheme in ("", "file"):
                    folder = f"{urlparse(spill_url).path}/{uuid.uuid4().hex}"
                    os.makedirs(folder, exist_ok=True)
                yield from aggregate_file(ds.dataset(inner, filesystem=system, format="parquet"), folder)
                if folder:
                    shutil.rmtree(folder, ignore_errors=True)

    paths = spark.createDataFrame([(p,) for p in ready], "path string").repartition(max(1, len(ready)))
    total = materialize(paths.mapInArrow(aggregate, "term string, tf bigint, df bigint"), "terms")
    for r in [*roots, spill_url]:
        drop_path(spark, r)
    return total


def dictionary_words(dictionary: DataFrame, lang: str = "en") -> DataFrame:
    """The cleaned words of one language: no byte-order mark, no outer white space, lower case."""
    word = F.lower(F.regexp_replace("word", "^[\\s\\h\\ufeff\\u200b]+|[\\s\\h\\ufeff\\u200b]+$", ""))
    return dictionary.filter(F.col("lang") == lang).select(word.alias("term")).filter("term <> ''").distinct()


def term_counts(docs: DataFrame, dictionary: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``term, tf, df`` of every word; the row with a null term has the number of non-null texts in ``df``."""
    partial = partial_counts(docs, text)
    if dictionary is not None:
        partial = partial.unionByName(dictionary_words(dictionary).select("term", F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("df")))
    return radix_aggregate(partial)


def term_bands(counts: DataFrame, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """``term, tf, df, band`` with band ``rare``, ``common`` or ``useful``."""
    n = counts.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))  # one row
    band = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.col("n") * common_share, "common").otherwise("useful")
    return counts.filter("term is not null").crossJoin(F.broadcast(n)).select("term", "tf", "df", band.alias("band"))
