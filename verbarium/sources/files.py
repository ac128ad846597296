"""Text files of a crawl: pages, links, addresses and word lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, text`` of ``<folder>/cleaned/<number>``: one text a file, UTF-8; other names and empty files are left out."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    files = spark.read.text(f"{folder}/cleaned", wholetext=True).select(name.alias("name"), F.col("value").alias("text"))
    return files.filter(F.col("name").rlike(r"^\d+$")).select(F.col("name").cast("bigint").alias("page_id"), "text")


def write_corpus(pages: DataFrame, folder: str, key: str = "page_id", text: str = "text") -> int:
    """Write each text to ``<folder>/cleaned/<key>``, and give their number; rows without key or text are left out.

    Keys are expected to be unique. A task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.create_dir(f"{inner}/cleaned", recursive=True)
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                with system.open_output_stream(f"{inner}/cleaned/{k}") as out:
                    out.write(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_lines(rows: DataFrame, path: str, *columns: str, sep: str = "\t") -> None:
    """Write the columns of each row as a line of text; nulls are empty."""
    rows.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.text(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst``: the first two columns between single white-space characters."""
    pieces = F.split("value", r"\s")
    return spark.read.text(path).select(F.get(pieces, F.lit(0)).try_cast("int").alias("src"), F.get(pieces, F.lit(1)).try_cast("int").alias("dst"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """``id, url`` from tab-separated lines; quotes are ordinary characters."""
    return spark.read.csv(path, sep="\t", schema="id int, url string", quote="")


def read_dictionary(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """``word, freq, lang`` from lines of a word and its frequency; a byte-order mark is dropped."""
    pieces = F.split(F.regexp_replace("value", "^\\ufeff", ""), r"\s")
    rows = spark.read.text(path).select(F.get(pieces, F.lit(0)).alias("word"), F.get(pieces, F.lit(1)).try_cast("double").alias("freq"))
    return rows.withColumn("lang", F.lit(lang))


def page_parts(pages: DataFrame, text: str = "text") -> DataFrame:
    """With ``page_id`` and ``url`` of a page's first two lines and its ``body``, the rest."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", "")))
    return pages.select(
        F.get(lines, F.lit(0)).try_cast("bigint").alias("page_id"),
        F.get(lines, F.lit(1)).alias("url"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n").alias("body"),
    )
